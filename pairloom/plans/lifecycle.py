"""A vocabulary that grows and shrinks: half-window snapshots, decisions, and the metrics and checks that go with them."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import cantor_key
from ..operators import discovery, selection, telemetry, transitions
from ..sources import sinks
from ..storage import materialize

SUMS = ("utility", "probability_sum", "support")
TOLERANCE = 1e-12
SELECTORS = ("stable", "sign", "balanced")


def snapshot(records: DataFrame) -> DataFrame:
    """(pair_key, utility, probability_sum, support, languages) of one window's records: a pair's sums and its languages in order."""
    nested = discovery.with_languages(discovery.merge_records(records))
    total = lambda c: F.aggregate(F.col(f"languages.{c}"), F.lit(0).cast("long" if c == "support" else "double"), lambda s, x: s + x).alias(c)
    sums = [total(c) for c in SUMS]
    return nested.select("pair_key", *sums, "languages")


def snapshot_problems(window: DataFrame, languages: int) -> DataFrame:
    """(pair_key, problem) of a snapshot's rows that may not be used: keys twice, languages out of order or range, numbers out
    of bounds, sums that are not those of the languages (to a relative 1e-12)."""
    x = F.col("languages")
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    index = F.transform(x, lambda e: e["lang_idx"])
    bad_entry = F.exists(x, lambda e: e["lang_idx"].isNull() | (e["lang_idx"] < 0) | (e["lang_idx"] >= languages) | ~number(e["utility"]) | ~number(e["probability_sum"]) | (e["support"] <= 0))
    total = lambda c: F.aggregate(F.col(f"languages.{c}"), F.lit(0.0), lambda s, e: s + e)
    near = lambda c: F.abs(total(c) - F.col(c)) <= F.greatest(F.lit(TOLERANCE), TOLERANCE * F.greatest(F.abs(total(c)), F.abs(F.col(c).cast("double"))))
    problem = (
        F.when(F.count("*").over(Window.partitionBy("pair_key")) > 1, "repeated_key").when(~number(F.col("utility")) | ~number(F.col("probability_sum")) | (F.col("support") <= 0), "number")
        .when(bad_entry, "language_entry").when(F.size(F.array_distinct(index)) < F.size(index), "repeated_language").when(F.array_sort(index) != index, "language_order")
        .when(~(near("utility") & near("probability_sum") & (total("support") == F.col("support"))), "sums")
    )
    return window.withColumn("problem", problem).where("problem IS NOT NULL").select("pair_key", "problem")


def save_window(window: DataFrame, folder: str, languages: int) -> None:
    """A snapshot written for a resumed run, if nothing is wrong with it."""
    bad = snapshot_problems(window, languages).head()
    if bad:
        raise ValueError(f"pair {bad['pair_key']}: {bad['problem']}")
    window.write.mode("errorifexists").parquet(folder)


def load_window(spark, folder: str, languages: int) -> DataFrame:
    """A snapshot read back under the same checks."""
    window = spark.read.parquet(folder)
    bad = snapshot_problems(window, languages).head()
    if bad:
        raise ValueError(f"{folder}: pair {bad['pair_key']}: {bad['problem']}")
    return window


def records_of(window: DataFrame) -> DataFrame:
    """One row per pair and language of a snapshot."""
    return window.select("pair_key", F.explode("languages").alias("x")).select("pair_key", "x.*")


def observed_tokens(first: DataFrame, second: DataFrame) -> DataFrame:
    """Token ids (token_id) that either half of a window used."""
    return first.select("token_id").unionByName(second.select("token_id")).distinct()


def diagnostic_windows(records: DataFrame) -> DataFrame:
    """(window_id, pair_key, lang_idx, and of utility and support the window's own and the sums since the first window): a
    resettable and a cumulative observer side by side."""
    own = records.groupBy("window_id", "pair_key", "lang_idx").agg(F.sum("utility").alias("utility"), F.sum("support").alias("support"))
    upto = Window.partitionBy("pair_key", "lang_idx").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    return own.select("*", F.sum("utility").over(upto).alias("total_utility"), F.sum("support").over(upto).alias("total_support"))


def replay_mismatches(recorded: DataFrame, replayed: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows in which a replay differs from what was recorded: a key on one side only, or another value. None are left if all is well."""
    both = recorded.select(*key, F.col(value).alias("recorded"), F.lit(True).alias("_a")).join(replayed.select(*key, F.col(value).alias("replayed"), F.lit(True).alias("_b")), key, "full")
    return both.where(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("recorded").eqNullSafe(F.col("replayed"))).select(*key, "recorded", "replayed")


def reactivated(rules: DataFrame, keys: DataFrame, base_tokens: int) -> DataFrame:
    """(token_id, key) of inactive rules among ``keys`` that become active again, both parts being active at their turn.

    Turns go in ascending key order, so a part that becomes active later does not help. Found in rounds: a rule may follow
    once its parts are base tokens, were active, or came back in an earlier round under a smaller key; no round can turn
    against another, so the rounds end where taking turns one by one does.
    """
    keyed = rules.select("token_id", "left", "right", "active", cantor_key("left", "right").alias("key"))
    asked = materialize(keyed.where("NOT active").join(keys.select(F.col("pair_key").alias("key")).distinct(), "key", "left_semi"))
    live = keyed.where("active").select("token_id", F.lit(-1).cast("long").alias("since"))
    back = asked.where("false").select("token_id", "key")
    while True:
        known = live.unionByName(back.select("token_id", F.col("key").alias("since")))
        out = asked.join(back.select("token_id"), "token_id", "left_anti")
        for side in ("left", "right"):
            out = out.join(known.select(F.col("token_id").alias(side), F.col("since").alias(f"_{side}")), side, "left")
        ready = lambda side: (F.col(side) < base_tokens) | (F.col(f"_{side}") < F.col("key"))
        new = materialize(out.where(ready("left") & ready("right")).select("token_id", "key"))
        if new.isEmpty():
            return back
        back = materialize(back.unionByName(new))


@dataclass(frozen=True)
class LifecycleSettings:
    """How a decision is made: the selector, whether unused rules are switched off and on, and bounds.

    ``target_rows`` bounds active rules with the ``balanced`` selector, learned ones if ``bidirectional`` is off.
    """

    selector: str = "stable"
    bidirectional: bool = True
    min_support: int = 32
    per_language_min_support: int = 8
    alpha: float = 0.05
    target_rows: int | None = None
    max_span: int = 32
    max_bytes: int | None = None
    dim: int = 0

    def __post_init__(self):
        if self.selector not in SELECTORS or (self.selector == "balanced") != (self.target_rows is not None):
            raise ValueError(f"selector {self.selector} with target {self.target_rows}")
        if min(self.min_support, self.per_language_min_support, self.max_span) < 1 or not 0 < self.alpha < 1:
            raise ValueError("bounds out of range")


def decide(first: DataFrame, second: DataFrame, used: DataFrame, rules: DataFrame, base_tokens: int, settings: LifecycleSettings, folder: str | Path | None = None, step: int = 0) -> tuple[DataFrame, dict]:
    """(rules, counts) after a decision at the end of a window, from the records of its halves and the tokens ``used`` in them.

    Rules that nothing used needs are switched off; pairs are selected that are no active rule; selected rules that were
    switched off come back where their parts are active; the others become rules of one new generation. More bytes than
    allowed, or more rows than the target, are errors. With ``folder``, a manifest of the step, which is never overwritten.
    """
    generation = rules.agg(F.coalesce(F.max("generation"), F.lit(0))).head()[0]
    before = materialize(rules)
    now = materialize(transitions.deactivate_unobserved(before, used, generation)) if settings.bidirectional else before
    switched_off = before.where("active").count() - now.where("active").count()
    named = now.withColumn("pair_key", cantor_key("left", "right"))
    existing = (named.where("active") if settings.bidirectional else named).select("pair_key")
    if settings.selector == "balanced":
        rows = now.where("active").count() if settings.bidirectional else now.count()
        chosen = selection.balanced_growth(first, second, existing, max(0, settings.target_rows - rows), settings.min_support, settings.per_language_min_support).select("pair_key")
    else:
        judge = selection.sign_growth(first, second, existing, settings.alpha) if settings.selector == "sign" else selection.stable_growth(first, second, existing, settings.min_support, settings.per_language_min_support)
        chosen = judge.where("outcome = 'selected'").select("pair_key")
    chosen = materialize(chosen)
    back = materialize(reactivated(now, chosen, base_tokens)) if settings.bidirectional else None
    if back is not None:
        now = materialize(now.join(back.select("token_id", F.lit(True).alias("_back")), "token_id", "left").withColumn("active", F.col("active") | F.coalesce("_back", F.lit(False))).drop("_back"))
    from ..functions.keys import cantor_left, cantor_right

    novel = chosen.join(named.select("pair_key"), "pair_key", "left_anti").select(cantor_left("pair_key").cast("int").alias("left"), cantor_right("pair_key").cast("int").alias("right"))
    made = materialize(transitions.next_rules(now, base_tokens, novel, generation + 1, settings.max_span))
    accepted = made.where("outcome = 'accepted'")
    added = accepted.count()
    if settings.max_bytes is not None:
        need = made.sparkSession.range(1).select(transitions.bytes_needed(F.lit(now.count() + added), settings.dim, recursive=True)).head()[0]
        if need > settings.max_bytes:
            raise ValueError(f"{need} bytes for {added} more rows")
    new = accepted.select(F.col("token_id").cast(dict(now.dtypes)["token_id"]), "left", "right", F.col("generation").cast("int"), F.lit(True).alias("active"), "span")
    out = materialize(now.select(*new.columns).unionByName(new))
    active = out.where("active").count()
    if settings.target_rows is not None and (active if settings.bidirectional else out.count()) > settings.target_rows:
        raise ValueError("more rows than the target")
    counts = {"step": step, "deactivated": switched_off, "selected": chosen.count(), "reactivated": back.count() if back is not None else 0, "added": added, "active": active, "learned": out.count(), "generation": generation + (added > 0)}
    counts["refused"] = {r["outcome"]: r["n"] for r in made.where("outcome <> 'accepted'").groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    if folder is not None:
        sinks.write_json(counts, Path(folder) / f"decision-{step}.json", overwrite=False)
    return out, counts


def rule_counts(rules: DataFrame) -> DataFrame:
    """One row: learned and active rules, the last generation, and a digest of the rule columns that does not depend on their order."""
    h = F.xxhash64("token_id", "left", "right", "generation", "active", "span")
    return rules.agg(F.count("*").alias("learned"), F.count_if("active").alias("active"), F.coalesce(F.max("generation"), F.lit(0)).alias("generation"), F.sha2(F.concat_ws("|", F.count("*"), F.sum(h.cast("decimal(38,0)"))), 256).alias("digest"))


ARMS = ("hashed", "exact", "online")


@dataclass(frozen=True)
class TelemetrySettings:
    """What is measured: the kind of vocabulary, steps per window, rows sampled and the corpus that it belongs to."""

    arm: str
    interval_steps: int = 100
    max_norm: float = 1.0
    sample_rows: int = 4096
    sample_seed: int = 0
    corpus_manifest: str = ""
    corpus_sha256: str = ""

    def __post_init__(self):
        if self.arm not in ARMS or self.interval_steps < 1 or self.sample_rows < 1 or not self.max_norm > 0:
            raise ValueError("settings out of range")
        if self.corpus_manifest and sinks.sha256_file(self.corpus_manifest) != self.corpus_sha256:
            raise ValueError("the corpus is another")


def flush(steps: DataFrame, parameters: DataFrame, gradients: DataFrame, settings: TelemetrySettings) -> DataFrame:
    """(window_id, window metrics, parameter statistics, gradient norms and the clip coefficient): one row per window.

    ``steps`` as for ``telemetry.window_metrics``; ``parameters`` has (window_id, group, value), of which at most
    ``sample_rows`` per window and group are measured, the same ones for a seed; ``gradients`` (window_id, group, tensor,
    value). A value that is not finite is an error.
    """
    for name, df in (("parameters", parameters), ("gradients", gradients)):
        if df.where(~discovery.finite("value")).head():
            raise ValueError(f"{name} are not finite")
    from ..operators.sampling import sample_rows

    metrics = telemetry.window_metrics(steps, settings.interval_steps)
    sampled = sample_rows(parameters.withColumn("_id", F.monotonically_increasing_id()), settings.sample_rows, ["window_id", "group"], "_id", settings.sample_seed)
    stats = sampled.groupBy("window_id", "group").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    stats = stats.groupBy("window_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("group", F.struct("mean", "std", "least", "greatest"))))).alias("parameters"))
    placed = gradients.withColumn("_g", F.concat_ws("/", "window_id", "group"))
    norms = telemetry.gradient_norms(placed, "value", "tensor", "_g").withColumns({"window_id": F.split("_g", "/")[0].cast("long"), "group": F.element_at(F.split("_g", "/"), -1)})
    grads = norms.groupBy("window_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("group", "norm")))).alias("gradients"), F.sqrt(F.sum(F.col("norm") * F.col("norm"))).alias("norm"))
    out = metrics.join(stats, "window_id", "left").join(grads, "window_id", "left")
    return out.withColumn("clip", telemetry.clip_coefficient("norm", settings.max_norm))
