"""Batches of identity decisions: which outside title each catalogue row takes, under budgets that the rows of a batch share.

A row goes through the stages decide, look up, judge, fill, assign and review; each stage's verdict says which rows the next one
reads. Rows draw on two budgets in the order of their ids: lookups of a cycle and merging or overwriting writes of a day. As a row
takes what it needs while there is any left, what is left for it is the budget less the running total of the rows before
it, so no row waits for another one's result.

Plans are made on the rows as they stood before the batch. Of rows of a batch that want one id tuple the first is served and the
others wait for the next batch, where they meet it as the holder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.functions.scalars import season_year_check
from catalume.functions.text import marked_season
from catalume.operators.identity import identity_plan, infer_season, provider_decision, review_key, review_unchanged, type_conflict
from catalume.operators.pick import running_totals
from catalume.operators.tables import cut

BODY = (
    "movie_results array<struct<id:bigint>>, tv_results array<struct<id:bigint>>, number_of_seasons int, release_date string, first_air_date string, "
    "seasons array<struct<season_number:int,episode_count:int,air_date:string>>"
)
#: Reasons that rest on one provider's word, and reasons that wait for a ranking instead of being refused.
VERIFIED = ("single-provider", "season-unknown")
WAITING = ("providers-disagree", "single-vs-existing", "type-mismatch", "provider-unverified", "season-disagree", "season-vs-title", "season-single-dissent", "season-unresolved")


@dataclass(frozen=True)
class Settings:
    """``tiers`` may be written in mode apply; ``written`` counts merging or overwriting writes of the day so far."""

    mode: str = "apply"
    tiers: tuple[str, ...] = ("fill", "season", "overwrite", "merge")
    lookups: int = 200
    writes: int = 50
    written: int = 0
    verify: bool = True

    def key(self) -> str:
        return f"{self.mode}:{','.join(sorted(self.tiers))}"

    def enabled(self, tier: Column) -> Column:
        return F.lit(self.mode == "apply") & F.coalesce(tier.isin(*self.tiers), F.lit(False))


def only_result(body: Column) -> Column:
    """The title of a search answer that names exactly one, as (id, media)."""
    titles = lambda field, media: F.transform(F.coalesce(body[field], F.array().cast("array<struct<id:bigint>>")), lambda x: F.struct(x["id"].alias("id"), F.lit(media).alias("media")))
    found = F.concat(titles("movie_results", "movie"), titles("tv_results", "tv"))
    one = F.try_element_at(found, F.lit(1))
    return F.when((F.size(found) == 1) & (one["id"] > 0), one)


def show_season(row: Column, show: Column) -> Column:
    """(season, reason): the title's marker, the only season of the show, or what its seasons' years and lengths say."""
    years = F.transform(
        F.array_sort(F.coalesce(show["seasons"], F.array().cast("array<struct<season_number:int,episode_count:int,air_date:string>>"))),
        lambda s: F.struct(s["season_number"].alias("number"), F.coalesce(s["episode_count"], F.lit(0)).alias("episodes"), F.substring(s["air_date"], 1, 4).try_cast("int").alias("year")),
    )
    guess = infer_season(row["year"], row["total"], row["title"], row["original"], row["slug"], years)
    marker = marked_season(row["title"], row["slug"])
    sure = F.coalesce(marker, F.when(show["number_of_seasons"] == 1, 1))
    season = F.when(show.isNull(), marker).otherwise(F.coalesce(sure, guess["season"]))
    return F.struct(season.alias("season"), F.when(season.isNull(), F.when(show.isNull(), "tmdb-show-missing").otherwise(F.coalesce(guess["reason"], F.lit("season-unresolved")))).alias("reason"))


ROW = ("tmdb_id", "tmdb_media", "tmdb_season", "imdb", "display", "pinned", "title", "slug", "original", "year", "total")


def met_by(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` left joined with ``other``. Rows whose first column of ``on`` is null meet nothing and are not moved: a join would send
    all of them to one task."""
    keyed = F.col(on[0]).isNotNull()
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema if f.name not in on]
    return rows.where(keyed).join(other, on, "left").unionByName(rows.where(~keyed).select("*", *blank))


def decide(rows: DataFrame, reviews: DataFrame, settings: Settings) -> DataFrame:
    """``rows`` (id, ROW, claims, ...) with ``row``, ``key``, ``skipped`` and ``d``, the decision (null if skipped)."""
    row = F.struct(*[F.col(c) for c in ROW])
    stored = reviews.select(F.col("id"), F.struct("key", "status", "outcome").alias("_r"))
    seen = rows.withColumn("row", row).withColumn("key", review_key(F.col("claims"), F.col("row"), F.lit(settings.key()))).join(stored, "id", "left")
    skipped = F.coalesce(review_unchanged(F.col("_r.key"), F.col("_r.status"), F.col("_r.outcome"), F.col("key")), F.lit(False))
    return seen.withColumn("skipped", skipped).withColumn("d", F.when(~F.col("skipped"), provider_decision(F.col("row"), F.col("claims")))).drop("_r")


def look_up(decided: DataFrame, bodies: DataFrame, settings: Settings, bucket: Column) -> DataFrame:
    """Adds ``e`` (action, tier, reason, tmdb_id, media, season, detail, from_show), the decision after at most two lookups;
    ``lookups`` (made), ``failed`` (answers that are not there) and ``missed`` (a lookup was refused or failed)."""

    def answered(asking: DataFrame, n: int) -> DataFrame:
        answers = bodies.select(F.col("path").alias(f"_p{n}"), F.col("body").alias(f"_b{n}"), F.lit(True).alias(f"_t{n}"))
        return met_by(asking, answers, [f"_p{n}"]).withColumn(f"_b{n}", F.from_json(f"_b{n}", BODY))  # only what is asked for is parsed

    d = F.col("d")
    own = F.array_compact(F.array_distinct(F.transform("claims", lambda c: c["imdb"])))
    imdb = F.coalesce("imdb", F.when(F.size(own) == 1, F.try_element_at(own, F.lit(1))))
    first = decided.withColumn("_imdb", imdb).withColumn("_p1", F.when(d["action"] == "find", F.concat(F.lit("/find/"), "_imdb", F.lit("?external_source=imdb_id"))))
    found = answered(first, 1).withColumn("_hit", only_result(F.col("_b1")))
    hit, asked = F.col("_hit"), F.col("_p1").isNotNull()
    odd = type_conflict(F.col("display"), hit["media"])

    def verdict(action, reason, tier=None, number=None, media=None):
        text = lambda x: F.lit(None).cast("string") if x is None else x if isinstance(x, Column) else F.lit(x)
        return F.struct(
            text(action).alias("action"), text(tier).alias("tier"), text(reason).alias("reason"), (F.lit(None) if number is None else number).cast("long").alias("tmdb_id"),
            text(media).alias("media"), F.lit(None).cast("int").alias("season"), F.when(F.lit(action == "blocked"), F.concat_ws(":", hit["media"], hit["id"].cast("string"))).alias("detail"),
        )

    told = F.struct(*[d[c].alias(c) for c in ("action", "tier", "reason", "tmdb_id", "media", "season")], F.lit(None).cast("string").alias("detail"))
    after = (
        F.when(~asked | F.col("_t1").isNull(), told).when(hit.isNull(), verdict("none", "find-no-unique-result")).when(odd, verdict("blocked", "find-type-mismatch"))
        .when(hit["media"] == "tv", verdict("resolve-season", "imdb-find", "fill", hit["id"], hit["media"])).otherwise(verdict("assign", "imdb-find", "fill", hit["id"], hit["media"]))
    )
    found = cut(found.withColumn("_a", after).select("*", *[F.col(f"_a.{c}").alias(f"_{c}") for c in ("action", "tier", "reason", "tmdb_id", "media", "season", "detail")]).drop("_a"))
    resolves = F.col("_action") == "resolve-season"
    checks = (F.col("_action") == "assign") & F.col("_reason").isin(*VERIFIED) & F.lit(settings.verify)
    path = F.when(resolves, F.concat(F.lit("/tv/"), F.col("_tmdb_id").cast("string"))).when(checks, F.concat_ws("/", F.lit(""), "_media", F.col("_tmdb_id").cast("string")))
    both = answered(found.withColumn("_p2", path), 2)

    wants = F.col("_p1").isNotNull().cast("int") + F.col("_p2").isNotNull().cast("int")
    counted = running_totals(cut(both.withColumn("_wants", wants)), [], bucket, ["id"], F.col("_wants"), "_upto")
    made = F.greatest(F.lit(0), F.least(F.col("_wants"), settings.lookups - (F.col("_upto") - F.col("_wants"))))
    counted = counted.withColumn("lookups", made.cast("int"))
    last_there = F.when(F.col("_p2").isNotNull(), F.col("_t2")).when(asked, F.col("_t1")).otherwise(F.lit(True))
    failed = (F.col("_wants") > 0) & (F.col("lookups") == F.col("_wants")) & last_there.isNull()
    counted = counted.withColumn("failed", failed).withColumn("missed", failed | (F.col("lookups") < F.col("_wants")))

    # a season from the show, then the year of what one provider alone says
    season = show_season(F.col("row"), F.col("_b2"))
    out = counted.withColumn("_s", F.when(resolves, season)).withColumn("_found", F.when(resolves, F.col("_s.season")).otherwise(F.col("_season")))
    lost = resolves & F.col("_found").isNull()
    unsure = F.col("_reason").isin(*VERIFIED) & F.lit(settings.verify) & (resolves | checks) & ~lost
    why = F.when(unsure, season_year_check(F.col("year"), F.col("_media"), F.col("_found"), F.col("_b2")))
    out = out.withColumn("_why", why)
    stays = F.col("missed") | ~(resolves | checks)
    queued = lost | F.col("_why").isNotNull()
    kept = ~stays & queued
    fields = {
        "action": F.when(stays, F.col("_action")).when(queued, "queue").otherwise("assign"), "tier": F.col("_tier"),
        "reason": F.when(~kept, F.col("_reason")).when(lost, "season-unresolved").otherwise("provider-unverified"), "tmdb_id": F.col("_tmdb_id"), "media": F.col("_media"),
        "season": F.when(stays, F.col("_season")).otherwise(F.col("_found")),
        "detail": F.when(kept, F.when(lost, F.col("_s.reason")).otherwise(F.col("_why"))).otherwise(F.col("_detail")),
    }
    return out.withColumn("e", F.struct(*[c.alias(n) for n, c in fields.items()])).select(*decided.columns, "_imdb", "lookups", "failed", "missed", "e")


def assign(looked: DataFrame, stored: DataFrame, settings: Settings, bucket: Column) -> DataFrame:
    """Adds ``result``: null for rows that assign nothing, else assigned, merged, planned, noop, blocked or deferred, with its reason."""
    e = F.col("e")
    asks = looked.where(~F.coalesce("skipped", F.lit(False)) & ~F.coalesce("missed", F.lit(False)) & (e["action"] == "assign"))
    wanted = cut(asks.select("id", e["tmdb_id"].alias("tmdb_id"), e["media"].alias("media"), e["season"].alias("season"), e["tier"].alias("tier"), F.col("tmdb_id").isNotNull().alias("replace")))
    plan = identity_plan(stored, wanted.drop("tier")).select("id", F.col("action").alias("plan"), F.col("reason").alias("plan_reason"), "survivor", "dropped")
    both = wanted.join(plan, "id")
    enabled, merges = settings.enabled(F.col("tier")), "merge" in settings.tiers and settings.mode == "apply"
    writes = enabled & ((F.col("plan") == "assign") | ((F.col("plan") == "merge") & F.lit(merges)))
    tuple_ = ("media", "tmdb_id", F.coalesce("season", F.lit(-1)).alias("_season"))
    first = both.where(writes).groupBy(*tuple_).agg(F.min("id").alias("_first"))
    both = both.withColumn("_season", F.coalesce("season", F.lit(-1))).join(first, ["media", "tmdb_id", "_season"], "left")
    both = both.withColumn("waits", F.coalesce(writes & (F.col("id") != F.col("_first")), F.lit(False)))
    scarce = F.col("tier").isin("season", "overwrite")
    uses = writes & ~F.col("waits") & (scarce | (F.col("plan") == "merge"))
    counted = running_totals(cut(both.withColumn("_uses", F.coalesce(uses, F.lit(False)).cast("int"))), [], bucket, ["id"], F.col("_uses"), "_upto")
    spent = F.col("_upto") - F.col("_uses") >= max(0, settings.writes - settings.written)
    late = enabled & spent & (scarce | ((F.col("plan") == "merge") & F.lit(merges)))
    result = (
        F.when(late, "deferred").when(F.col("waits"), "deferred").when(F.col("plan").isin("noop", "blocked"), F.col("plan"))
        .when((F.col("plan") == "merge") & F.lit(not merges), "planned").when(~enabled, "planned").when(F.col("plan") == "merge", "merged").otherwise("assigned")
    )
    why = F.when(late, "daily-cap").when(F.col("waits"), "tuple-in-batch").otherwise(F.col("plan_reason"))
    return looked.join(counted.select("id", F.struct(result.alias("result"), why.alias("why"), "plan", "survivor", "dropped").alias("w")), "id", "left")


def fill_imdb(judged: DataFrame, stored: DataFrame, settings: Settings) -> DataFrame:
    """Adds ``imdb_outcome``: imdb-filled, imdb-taken, imdb-planned, imdb-conflict or null.

    A row without season shares no IMDb id with another such row of its type: what rows with smaller ids have become in this
    batch counts, and what those with greater ids were before.
    """
    change = F.col("w.result").isin("assigned", "merged")
    after = F.when(F.coalesce(change, F.lit(False)), F.col("e.season")).otherwise(F.col("tmdb_season"))
    asks = ~F.col("skipped") & (F.col("d.imdb_action") == "fill") & F.col("imdb").isNull()
    rows = judged.withColumn("_asks", F.coalesce(asks, F.lit(False))).withColumn("_after", after)
    held = stored.where("imdb is not null").join(rows.select("id", F.col("_after"), F.lit(True).alias("_in")), "id", "left")
    now = F.when(F.col("_in"), F.col("_after")).otherwise(F.col("season"))
    held = held.groupBy("imdb", "display").agg(F.max(F.when(F.col("season").isNull(), F.col("id"))).alias("_before"), F.min(F.when(now.isNull(), F.col("id"))).alias("_now"))
    keyed = met_by(rows, held.withColumnRenamed("imdb", "_imdb"), ["_imdb", "display"])
    free = F.col("tmdb_season").isNotNull() | ~F.coalesce((F.col("_before") > F.col("id")) | (F.col("_now") < F.col("id")), F.lit(False))
    keyed = cut(keyed.withColumn("_free", F.col("_asks") & free))
    earlier = keyed.where(F.col("_free") & F.col("_after").isNull()).groupBy("_imdb", "display").agg(F.min("id").alias("_filler"))
    out = met_by(keyed, earlier, ["_imdb", "display"])
    taken = ~F.col("_free") | (F.col("tmdb_season").isNull() & F.coalesce(F.col("_filler") < F.col("id"), F.lit(False)))
    able = settings.enabled(F.lit("fill"))
    outcome = F.when(F.col("_asks"), F.when(~able, "imdb-planned").when(taken, "imdb-taken").otherwise("imdb-filled")).when(~F.col("skipped") & (F.col("d.imdb_action") == "conflict"), "imdb-conflict")
    return out.withColumn("imdb_outcome", outcome).drop("_asks", "_after", "_free", "_filler", "_before", "_now")


def resolve_batch(rows: DataFrame, bodies: DataFrame, reviews: DataFrame, settings: Settings, bucket: Column | None = None) -> DataFrame:
    """One row for each of ``rows``: id, state (skipped, deferred, assigned, merged, planned, noop, queued, blocked), action, reason, tier,
    tmdb_id, media, season, survivor, dropped, imdb_outcome, lookups, failed; and its review, null where none is saved: key (of the row as
    it is after its own writes), status (done, planned, pending, blocked), outcome.

    rows: id, state, ROW, claims, providers, filled, created; bodies: path, body (landed answers as JSON, null for a title that does
    not exist; a path without a row is a failed lookup); reviews: id, key, status, outcome. ``bucket`` rises with the id and cuts the
    batch into runs that one task can sort.
    """
    bucket = F.floor(F.col("id") / 4096) if bucket is None else bucket
    stored = rows.select("id", "state", "tmdb_id", F.col("tmdb_media").alias("media"), F.col("tmdb_season").alias("season"), "imdb", "year", "title", "slug", "pinned", "providers", "filled", "created", "display")
    looked = cut(look_up(cut(decide(rows, reviews, settings)), bodies, settings, bucket))
    done = fill_imdb(cut(assign(looked, stored.drop("display"), settings, bucket)), stored, settings)

    e, w = F.col("e"), F.col("w")
    state = (
        F.when(F.col("skipped"), "skipped").when(F.col("missed"), "deferred").when(w.isNotNull(), w["result"])
        .when(e["action"] == "queue", "queued").when(e["action"] == "blocked", "blocked").otherwise("noop")
    )
    done = done.withColumn("became", state)
    became = F.col("became")
    folded = (became == "merged") & (w["dropped"] == F.col("id"))
    saved = ~became.isin("skipped", "deferred") & ~F.coalesce(folded, F.lit(False))
    reason = F.when(F.col("missed"), "lookup-deferred").when(became == "deferred", w["why"]).when(became == "skipped", None).otherwise(e["reason"])
    status = (
        F.when(became == "planned", "planned").when(became.isin("assigned", "merged"), "done").when(became == "queued", F.when(e["reason"].isin(*WAITING), "pending").otherwise("blocked"))
        .when(became == "blocked", "blocked").when(F.col("imdb_outcome") == "imdb-planned", "planned").otherwise("done")
    )
    said = (
        F.when(became.isin("assigned", "merged"), became).when(became == "planned", F.concat(F.lit("would-"), w["plan"])).when(w.isNotNull() & (became == "blocked"), w["why"])
        .when(w.isNotNull() & (became == "noop"), "noop").when(became == "queued", e["detail"])
    )
    outcome = F.nullif(F.concat_ws(";", said, "imdb_outcome"), F.lit(""))
    # the row after its own writes, which the next batch compares with
    wrote, filled = became.isin("assigned", "merged"), F.col("imdb_outcome") == "imdb-filled"
    put = {"tmdb_id": F.when(wrote, e["tmdb_id"]).otherwise(F.col("tmdb_id")), "tmdb_media": F.when(wrote, e["media"]).otherwise(F.col("tmdb_media")), "tmdb_season": F.when(wrote, e["season"]).otherwise(F.col("tmdb_season"))}
    put["imdb"] = F.when(filled, F.col("_imdb")).otherwise(F.col("imdb"))
    current = F.struct(*[c.alias(n) for n, c in put.items()], F.col("pinned"))
    key = review_key(F.col("claims"), current, F.lit(settings.key()))
    told = lambda c: F.when(became != "skipped", c)
    return done.select(
        "id", became.alias("state"), told(e["action"]).alias("action"), reason.alias("reason"), told(e["tier"]).alias("tier"), told(e["tmdb_id"]).alias("tmdb_id"), told(e["media"]).alias("media"),
        told(e["season"]).alias("season"), w["survivor"].alias("survivor"), w["dropped"].alias("dropped"), "imdb_outcome", F.coalesce("lookups", F.lit(0)).alias("lookups"), "failed",
        F.when(saved, key).alias("key"), F.when(saved, status).alias("status"), F.when(saved, outcome).alias("outcome"),
    )


def tallies(batch: DataFrame) -> DataFrame:
    """name, n: how many rows became what, why, and what was spent."""
    ones = batch.select(F.explode(F.array_compact(F.array(
        F.concat(F.lit("state:"), "state"), F.concat(F.lit("reason:"), F.when(F.col("state").isin("deferred", "queued", "blocked"), F.col("reason"))), F.col("imdb_outcome"), F.when(F.col("failed"), "failed-lookups"),
    ))).alias("name"), F.lit(1).alias("n")).unionByName(batch.select(F.lit("lookups").alias("name"), F.col("lookups").alias("n")))
    return ones.groupBy("name").agg(F.sum("n").alias("n")).where("n > 0")
