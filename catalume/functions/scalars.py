"""Numbers, dates, hashes, URLs and arrays of the catalogue, as functions from columns to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positive(value: Column) -> Column:
    """The number, or null unless it is above 0."""
    number = value.try_cast("double")
    return F.when(number > 0, number)


def rating(value: Column) -> Column:
    """A rating of 0 to 10 to one decimal, else null."""
    number = value.try_cast("double")
    return F.when(number.between(0, 10), F.round(number, 1))


def percentage(value: Column) -> Column:
    """A whole percentage of 0 to 100, else null."""
    number = value.try_cast("double")
    return F.when(number.between(0, 100), F.round(number).cast("int"))


def dice(a: Column, b: Column) -> Column:
    """Twice the common distinct elements over all distinct elements of both arrays."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when(F.size(a) + F.size(b) > 0, 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def wilson(hits: Column, n: Column, upper: bool, z: float = 1.96) -> Column:
    """A bound of the Wilson score interval of hits / n; null without trials."""
    p = hits / n
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, (p + z * z / (2 * n) + (spread if upper else -spread)) / (1 + z * z / n))


def retry_delay(base: Column, failures: Column, most: Column) -> Column:
    """Doubles with each failure, up to ``most``."""
    return F.least(most, base * F.pow(F.lit(2.0), failures))


def year_check(mine: Column, theirs: Column, slack: int = 1) -> Column:
    """True or false if both years are known, else null."""
    return F.when(mine.isNotNull() & theirs.isNotNull(), F.abs(mine - theirs) <= slack)


def host(url: Column) -> Column:
    """The text between // and the next slash."""
    return F.split_part(F.split_part(url, F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))


def rolling_hash(text: Column, modulus: int = 1000) -> Column:
    """h = h * 31 + code point, in 32 bits, at last modulo ``modulus``."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % (1 << 32)) % modulus


def weekly_slot(ts: Column, weekday: int, hour: int, offset_hours: int = 7) -> Column:
    """Epoch seconds of the latest weekly slot at or before ``ts``, in a zone ``offset_hours`` ahead of UTC; weekday 0 is Sunday."""
    week, shift = 7 * 86_400, offset_hours * 3600
    anchor = (weekday + 3) % 7 * 86_400 + hour * 3600 - shift  # day 0 of the epoch was a Thursday
    seconds = F.unix_timestamp(ts)
    return seconds - F.pmod(seconds - anchor, F.lit(week))


def present(value: Column) -> Column:
    return value.isNotNull() & (F.trim(value.cast("string")) != "")


def hash_key(*columns: Column) -> Column:
    """SHA-256 of the values joined by a zero character, null counting as empty."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def review_score(rating: Column, text: Column, created: Column, now: Column, weights=(0.6, 0.25, 0.15), neutral: float = 50.0, length_cap: int = 1500, decay: float = 0.95) -> Column:
    """0 to 100 to two decimals: the rating of 0 to 10, the length up to a cap, and age, which fades by ``decay`` a month of 30.4375 days."""
    months = F.greatest(F.lit(0.0), (F.unix_millis(now) - F.unix_millis(created)) / F.lit(30.4375 * 86_400_000))
    rated = F.when(rating.isNull(), F.lit(neutral)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), rating * 10)))
    long = F.least(F.lit(1.0), F.length(F.coalesce(text, F.lit(""))) / F.lit(float(length_cap))) * 100
    fresh = F.when(created.isNull(), F.lit(0.0)).otherwise(100 * F.pow(F.lit(decay), months))
    total = (rated * weights[0] + long * weights[1] + fresh * weights[2]) / sum(weights)
    return F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)) * 100 + 0.5) / 100


def url_part(url: Column, part: str) -> Column:
    """HOST, PATH or PROTOCOL of a URL; null for what is none."""
    return F.try_parse_url(F.trim(url), F.lit(part))


def under_host(name: Column, hosts: list[str]) -> Column:
    """Whether a host is one of ``hosts`` or below one of them."""
    test = F.lit(False)
    for h in hosts:
        test = test | (name == h) | name.endswith(f".{h}")
    return test


def image_url(url: Column, allowed: list[str], dead: list[str] = ()) -> Column:
    """An https URL of an allowed, living host that has a path, without its fragment; else null."""
    name, path = F.lower(url_part(url, "HOST")), F.coalesce(url_part(url, "PATH"), F.lit(""))
    good = (F.lower(url_part(url, "PROTOCOL")) == "https") & under_host(name, allowed) & ~under_host(name, list(dead)) & ~path.isin("", "/")
    return F.when(good, F.regexp_replace(F.trim(url), "#.*$", ""))


def season_year_check(year: Column, media: Column, season: Column, body: Column) -> Column:
    """Null if a title fits the row's year, else why not: ``missing`` or ``year-`` and its year. ``body``: release_date, first_air_date,
    seasons (season_number, air_date). A season is held against its own date; only the first may borrow the show's.
    """
    own = F.try_element_at(F.filter(body["seasons"], lambda s: s["season_number"] == season), F.lit(1))["air_date"]
    shown = F.coalesce(F.nullif(own, F.lit("")), F.when(F.coalesce(season, F.lit(1)) <= 1, body["first_air_date"]))
    found = F.substring(F.when(media == "movie", body["release_date"]).otherwise(shown), 1, 4).try_cast("int")
    odd = (year >= 1900) & (found >= 1900) & (F.abs(found - year) > 1)
    return F.when(body.isNull(), "missing").when(odd, F.concat(F.lit("year-"), found.cast("string")))
