"""Changes of vocabulary tables: slots, compaction, growth, folding, reclaiming, and the rules of recursive merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import cantor_key, key_left, key_right, pair_hash
from ..storage import materialize
from .ranking import running


def assign_slots(keys: DataFrame, base: int, buckets: int) -> DataFrame:
    """(pair_key, bucket, slot, moved): the smallest key of each bucket keeps it, the others move to the smallest free ones in key order.

    Free buckets are paired with movers by their places in the two orders, which are found by ranges. More keys than
    buckets are an error, since some mover would have no slot.
    """
    hashed = keys.select("pair_key").where("pair_key IS NOT NULL").distinct().withColumn("bucket", pair_hash(key_left("pair_key", base), key_right("pair_key", base), buckets))
    at = F.row_number().over(Window.partitionBy("bucket").orderBy("pair_key"))
    ranked = materialize(hashed.withColumn("_at", at))
    if ranked.count() > buckets:
        raise ValueError(f"more keys than the {buckets} buckets")
    free = keys.sparkSession.range(buckets).withColumnRenamed("id", "slot").join(ranked.select("bucket").distinct(), F.col("slot") == F.col("bucket"), "left_anti")
    movers = running(ranked.where("_at > 1").select("pair_key", "bucket"), ["pair_key"], place="_m")
    free = running(free, ["slot"], place="_m")
    kept = ranked.where("_at = 1").select("pair_key", "bucket", F.col("bucket").alias("slot"), F.lit(False).alias("moved"))
    return kept.unionByName(movers.join(free, "_m").select("pair_key", "bucket", "slot", F.lit(True).alias("moved")))


def compact(slots: DataFrame) -> DataFrame:
    """(pair_key, old_slot, slot): slots renumbered from 0 in key order, by ranges of keys so that no task sorts them all."""
    return running(slots.select("pair_key", F.col("slot").alias("old_slot")), ["pair_key"], place="slot").select("pair_key", "old_slot", "slot")


def fold_rows(table: DataFrame, row: str, vector: str, rows: int, dims: int) -> DataFrame:
    """(row, vector): the mean of the rows that are equal modulo ``rows``."""
    folded = table.withColumn("_r", F.pmod(F.col(row), F.lit(rows)))
    means = F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(dims)])
    return folded.groupBy("_r").agg(means.alias(vector)).withColumnRenamed("_r", row)


def grow(existing: DataFrame, added: DataFrame) -> DataFrame:
    """(pair_key, slot, is_new): existing keys (pair_key, slot) and new ones merged by key; a key in both keeps its row."""
    new = added.select("pair_key").distinct().join(existing.select("pair_key"), "pair_key", "left_anti").withColumn("slot", F.lit(None).cast("long")).withColumn("is_new", F.lit(True))
    every = existing.select("pair_key", F.col("slot").cast("long"), F.lit(False).alias("is_new")).unionByName(new)
    return compact(every).join(every.select("pair_key", "is_new"), "pair_key").select("pair_key", "old_slot", "slot", "is_new")


def reclaim(table: DataFrame, replaced: DataFrame, row: str = "token_id", vector: str = "vec") -> DataFrame:
    """``table`` with the vectors of ``replaced`` in place of its own where it has a row."""
    new = replaced.select(row, F.col(vector).alias("_new"))
    return table.join(new, row, "left").withColumn(vector, F.coalesce("_new", vector)).drop("_new")


def reclaim_problems(rules: DataFrame, base: int) -> DataFrame:
    """(token_id, problem) of rules (token_id, left, right) that may not reclaim a token: repeated, out of range, recursive or an endpoint."""
    ends = rules.select(F.col("left").alias("token_id")).unionByName(rules.select(F.col("right").alias("token_id"))).distinct().withColumn("_end", F.lit(True))
    counted = rules.withColumn("_times", F.count("*").over(Window.partitionBy("token_id"))).join(ends, "token_id", "left")
    problem = (
        F.when(F.col("_times") > 1, "repeated").when((F.col("token_id") < 0) | (F.col("token_id") >= base), "out_of_range")
        .when((F.col("token_id") == F.col("left")) | (F.col("token_id") == F.col("right")), "recursive").when(F.col("_end"), "endpoint")
    )
    return counted.withColumn("problem", problem).where("problem IS NOT NULL").select("token_id", "problem")


def disable_pairs(table: DataFrame, score: float = -30.0) -> DataFrame:
    """The control in which no pair has an effect: every gate is shut and every merged vector 0."""
    return table.withColumn("score", F.lit(score)).withColumn("vec", F.transform("vec", lambda x: F.lit(0.0)))


def ablate_bias(bias: DataFrame) -> DataFrame:
    """(lang_idx, bias) with the mean in place of each bias."""
    return bias.select("lang_idx", F.avg("bias").over(Window.partitionBy(F.lit(0))).alias("bias"))  # one row per language


def next_rules(rules: DataFrame, base_tokens: int, pairs: DataFrame, generation: int, max_span: int = 32) -> DataFrame:
    """One more generation of merge rules from candidate pairs (left, right): accepted rows and refused ones with a reason.

    (left, right, key, span, outcome, token_id, generation). Refused are pairs that are a rule already, whose parts are
    unknown, whose span is too long, or whose span is that of a rule or of an earlier key of this call. Ids continue in
    key order, which is found by ranges.
    """
    known = rules.select(F.col("token_id").alias("_t"), F.col("span").alias("_s"), "active")
    span_of = lambda side: F.when(F.col(side) < base_tokens, F.array(F.col(side).cast("int"))).otherwise(F.col(f"_{side}"))
    asked = pairs.select("left", "right").distinct().withColumn("key", cantor_key("left", "right"))
    for side in ("left", "right"):
        asked = asked.join(known.where("active").select(F.col("_t").alias(side), F.col("_s").alias(f"_{side}")), side, "left")
    asked = asked.withColumn("span", F.concat(span_of("left"), span_of("right")))
    ruled = rules.select(cantor_key("left", "right").alias("key"), F.lit(True).alias("_ruled")).distinct()
    spanned = rules.select("span", F.lit(True).alias("_spanned")).distinct()
    asked = asked.join(ruled, "key", "left").join(spanned, "span", "left")
    fine = F.col("_ruled").isNull() & F.col("span").isNotNull() & (F.size("span") <= max_span) & F.col("_spanned").isNull()
    first = F.row_number().over(Window.partitionBy("span", fine).orderBy("key")) == 1
    outcome = (
        F.when(F.col("_ruled"), "already_rule").when(F.col("span").isNull(), "unknown_parent").when(F.size("span") > max_span, "span_too_long")
        .when(F.col("_spanned") | ~first, "duplicate_span").otherwise("accepted")
    )
    out = asked.withColumn("outcome", outcome).select("left", "right", "key", "span", "outcome")
    start = rules.agg(F.coalesce(F.max("token_id") + 1, F.lit(base_tokens)).alias("_start"))
    out = materialize(out)
    placed = running(out.where("outcome = 'accepted'"), ["key"], place="_at").join(F.broadcast(start))  # one row
    accepted = placed.withColumn("token_id", (F.col("_start") + F.col("_at")).cast("long")).drop("_start", "_at")
    refused = out.where("outcome <> 'accepted'").withColumn("token_id", F.lit(None).cast("long"))
    return accepted.unionByName(refused).withColumn("generation", F.lit(generation))


def needed_rules(rules: DataFrame, observed: DataFrame, generations: int) -> DataFrame:
    """Token ids of the rules that observed tokens are built of, themselves included: one semi-join per generation."""
    seen = rules.join(observed.select("token_id").distinct(), "token_id", "left_semi").select("token_id")
    for _ in range(generations):
        parents = rules.join(seen, "token_id", "left_semi").select(F.explode(F.array("left", "right")).alias("token_id"))
        seen = seen.unionByName(rules.join(parents.distinct(), "token_id", "left_semi").select("token_id")).distinct()
    return seen


def deactivate_unobserved(rules: DataFrame, observed: DataFrame, generations: int) -> DataFrame:
    """``rules`` in which only what observed tokens need stays active."""
    need = needed_rules(rules, observed, generations).withColumn("_need", F.lit(True))
    return rules.join(need, "token_id", "left").withColumn("active", F.col("active") & F.coalesce("_need", F.lit(False))).drop("_need")


def reactivate(rules: list[dict], keys: list[int], base_tokens: int) -> list[int]:
    """Ids that become active again, in ascending key order; both parts must be active at that moment. ``rules`` is the collected table."""
    by_key = {(r["left"] + r["right"]) * (r["left"] + r["right"] + 1) // 2 + r["right"]: r for r in rules}
    active = {r["token_id"] for r in rules if r["active"]}
    out = []
    for key in sorted(set(keys)):
        r = by_key.get(key)
        if r and r["token_id"] not in active and all(x < base_tokens or x in active for x in (r["left"], r["right"])):
            active.add(r["token_id"])
            out.append(r["token_id"])
    return out


def rule_problems(rules: DataFrame, base_tokens: int) -> DataFrame:
    """(token_id, problem): parts that come later, repeated pairs or spans, spans that are not their parts', active rules with inactive parts."""
    own = rules.select(F.col("token_id").alias("_t"), F.col("span").alias("_s"), F.col("active").alias("_a"), F.col("generation").alias("_g"))
    out = rules
    for side in ("left", "right"):
        part = own.select(F.col("_t").alias(side), F.col("_s").alias(f"_s_{side}"), F.col("_a").alias(f"_a_{side}"))
        out = out.join(part, side, "left")
        base = F.col(side) < base_tokens
        out = out.withColumn(f"_s_{side}", F.when(base, F.array(F.col(side).cast("int"))).otherwise(F.col(f"_s_{side}"))).withColumn(f"_a_{side}", base | F.coalesce(F.col(f"_a_{side}"), F.lit(False)))
    twice = F.count("*").over(Window.partitionBy("left", "right")) > 1
    same = F.count("*").over(Window.partitionBy("span")) > 1
    problem = (
        F.when((F.col("left") >= F.col("token_id")) | (F.col("right") >= F.col("token_id")), "later_part").when(twice, "repeated_pair").when(same, "repeated_span")
        .when(~F.coalesce(F.concat("_s_left", "_s_right") == F.col("span"), F.lit(False)), "wrong_span").when(F.col("active") & ~(F.col("_a_left") & F.col("_a_right")), "inactive_part")
    )
    return out.withColumn("problem", problem).where("problem IS NOT NULL").select("token_id", "problem")


def migrate_state(state: DataFrame, moved: DataFrame, row: str = "row_id") -> DataFrame:
    """Per-row training state (``row``, moments...) carried along with rows: (``row``, moments...) of the new table.

    ``moved`` has (new_row, old_row): a new row takes the state of its old one, several may take the same. A row of
    ``moved`` whose old row has no state is an error, as growth needs state that has begun.
    """
    others = [c for c in state.columns if c != row]
    if moved.join(state.select(F.col(row).alias("old_row")), "old_row", "left_anti").head():
        raise ValueError("growth needs state for every row")
    return moved.join(state.withColumnRenamed(row, "old_row"), "old_row").select(F.col("new_row").alias(row), *others)


def parent_state(state: DataFrame, rules: DataFrame, vectors: list[str], row: str = "token_id") -> DataFrame:
    """State of new rules (token_id, left, right): the mean of their parents' vectors in each column of ``vectors``."""
    side = lambda name: state.select(F.col(row).alias(name), *[F.col(v).alias(f"_{name}_{v}") for v in vectors])
    both = rules.select(row, "left", "right").join(side("left"), "left").join(side("right"), "right")
    means = [F.zip_with(f"_left_{v}", f"_right_{v}", lambda a, b: (a.cast("double") + b) / 2).alias(v) for v in vectors]
    return both.select(row, *means)


def seed_rows(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``target`` with the columns of ``source`` where it has the key; a source key that the target lacks is an error."""
    if source.join(target, key, "left_anti").head():
        raise ValueError("the source has rows that the target lacks")
    new = source.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = target.join(new, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_new_{c}", c))
    return out.select(*target.columns)


def bytes_needed(rows: Column, dim: int, element: int = 4, recursive: bool = False) -> Column:
    """Bytes of a grown table with its optimizer's state."""
    return rows * (dim * 12 + 40) if recursive else rows * (dim + 1) * max(4, element) * 3
