"""Queries over window records: discovery, selection and vocabulary transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery, selection, sketches, transitions
from ..storage import materialize
from ..streaming import windows
from . import lifecycle
from .registry import query, read

_COLS = "window_id, pair_key, lang_idx, utility, probability_sum, support, positive_support"
REC = f"rec AS (SELECT DISTINCT record_id, {_COLS} FROM window_records WHERE pair_key IS NOT NULL AND lang_idx IS NOT NULL AND utility IS NOT NULL AND support IS NOT NULL)"
_SUMS = "sum(utility) AS utility, sum(probability_sum) AS probability_sum, sum(support)::BIGINT AS support, sum(positive_support)::BIGINT AS positive_support"
MERGED = f"{REC}, m AS (SELECT pair_key, lang_idx, {_SUMS} FROM rec GROUP BY 1, 2)"
ROLLED = f"{MERGED}, u AS (SELECT pair_key, {_SUMS}, count(DISTINCT lang_idx) AS language_count FROM m GROUP BY 1)"
#: Sums of utilities of six decimals are compared after rounding, so that the order of adding does not decide ties.
R = "round(utility, 6)"
HALVES = f"""{REC}, prev AS (SELECT pair_key, lang_idx, {_SUMS} FROM rec WHERE window_id < 20 GROUP BY 1, 2), cur AS (SELECT pair_key, lang_idx, {_SUMS} FROM rec WHERE window_id >= 20 GROUP BY 1, 2),
    old AS (SELECT DISTINCT pair_key FROM rec WHERE pair_key % 97 = 0),
    pu AS (SELECT pair_key, round(sum(utility), 6) AS u, sum(support) AS n, sum(positive_support) AS pos, sum(probability_sum) AS ps, max((round(utility, 6) > 0 AND support >= 4)::INT) AS ok FROM prev GROUP BY 1),
    cu AS (SELECT pair_key, round(sum(utility), 6) AS u, sum(support) AS n, sum(positive_support) AS pos, sum(probability_sum) AS ps, max((round(utility, 6) > 0 AND support >= 4)::INT) AS ok FROM cur GROUP BY 1)"""
_WIDTH = 4096
_W = "18446744073709551616::HUGEINT"


def _wrap(x: str) -> str:
    r = f"((({x}) % {_W} + {_W}) % {_W})"
    return f"(CASE WHEN {r} >= 9223372036854775808::HUGEINT THEN {r} - {_W} ELSE {r} END)"


def rec(spark, d):
    return discovery.once(read(spark, d, "window_records"))


def merged(spark, d):
    m = discovery.merge_records(rec(spark, d))
    return m.withColumn("utility", F.round("utility", 6))


def halves(spark, d):
    r = rec(spark, d)
    cut = lambda df: discovery.merge_records(df).withColumn("utility", F.round("utility", 6))
    # the existing vocabulary: keys of a fixed residue, as a stand-in for a saved one
    old = r.where("pair_key % 97 = 0").select("pair_key").distinct()
    return cut(r.where("window_id < 20")), cut(r.where("window_id >= 20")), old


@query(f"WITH {MERGED} SELECT pair_key, lang_idx, round(utility, 6) AS utility, round(probability_sum, 4) AS probability_sum, support, positive_support FROM m")
def pair_language_agg(spark, d):
    return merged(spark, d).select("pair_key", "lang_idx", "utility", F.round("probability_sum", 4).alias("probability_sum"), "support", "positive_support")


@query(f"WITH {ROLLED} SELECT pair_key, round(utility, 6) AS utility, support, positive_support, language_count FROM u")
def pair_rollup(spark, d):
    return discovery.roll_up(merged(spark, d)).select("pair_key", F.round("utility", 6).alias("utility"), "support", "positive_support", "language_count")


@query(f"WITH {REC} SELECT window_id, lang_idx, count(*) AS n, count(*) FILTER (utility > 0) AS positive, round(sum(utility), 6) AS utility FROM rec GROUP BY 1, 2")
def positive_support(spark, d):
    r = rec(spark, d)
    return r.groupBy("window_id", "lang_idx").agg(F.count("*").alias("n"), F.count_if(F.col("utility") > 0).alias("positive"), F.round(F.sum("utility"), 6).alias("utility"))


@query(f"WITH {ROLLED}, o AS (SELECT pair_key, support, row_number() OVER (ORDER BY support DESC, pair_key) AS rank FROM u) SELECT pair_key, support, rank, (SELECT support FROM o WHERE rank = 501) AS next_support FROM o WHERE rank <= 500")
def support_topk(spark, d):
    return discovery.top_pairs(discovery.roll_up(merged(spark, d)).select("pair_key", "support"), 500).select("pair_key", "support", F.col("rank").cast("long").alias("rank"), "next_support")


def _cm(depth: int, a: int, b: int) -> str:
    return f"SELECT pair_key, support, {depth} AS depth, (({_wrap(f'pair_key::HUGEINT * {a} + {b}')} % {_WIDTH} + {_WIDTH}) % {_WIDTH})::INT AS bucket, (((pair_key % 2) + {b % 2}) % 2)::INT * 2 - 1 AS sign FROM u"


_CELLS = " UNION ALL ".join(_cm(i, a, b) for i, (a, b) in enumerate(zip((6364136223846793005, 3202034522624059733, 3935559000370003845), (1442695040888963407, 2691343689449507681, 4768777513237032717))))


@query(f"WITH {ROLLED}, c AS ({_CELLS}), s AS (SELECT depth, bucket, sum(support) AS cell FROM c GROUP BY 1, 2) SELECT pair_key, min(cell)::BIGINT AS estimate FROM c JOIN s USING (depth, bucket) GROUP BY 1")
def count_min(spark, d):
    u = discovery.roll_up(merged(spark, d)).select("pair_key", "support")
    cells = sketches.sketch(u, "pair_key", "support", _WIDTH)
    return sketches.estimate(u.select("pair_key"), "pair_key", cells, _WIDTH)


@query(f"WITH {ROLLED}, c AS ({_CELLS}), s AS (SELECT depth, bucket, sum(support * sign) AS cell FROM c GROUP BY 1, 2) SELECT pair_key, list_sort(list((cell * sign)::BIGINT))[2] AS estimate FROM c JOIN s USING (depth, bucket) GROUP BY 1")
def countsketch_median(spark, d):
    u = discovery.roll_up(merged(spark, d)).select("pair_key", "support")
    cells = sketches.sketch(u, "pair_key", "support", _WIDTH, signed=True)
    return sketches.estimate(u.select("pair_key"), "pair_key", cells, _WIDTH, signed=True)


def _observations(spark, d):
    return rec(spark, d).select(F.col("window_id").alias("call_id"), "pair_key", "lang_idx", "utility", F.col("probability_sum").alias("p"))


@query(f"""
    WITH {REC}, g AS (SELECT window_id, pair_key, lang_idx, round(sum(utility), 6) AS u, count(*) AS n FROM rec GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY abs(u) DESC, pair_key, lang_idx) AS rk FROM g)
    SELECT pair_key, lang_idx, round(sum(u), 6) AS utility, sum(n)::BIGINT AS support FROM r WHERE rk <= 200 GROUP BY 1, 2""")
def top_per_forward(spark, d):
    calls = _observations(spark, d).groupBy("call_id", "pair_key", "lang_idx").agg(F.round(F.sum("utility"), 6).alias("utility"), F.count("*").alias("support"))
    kept = discovery.first_ranked(calls, 200).groupBy("pair_key", "lang_idx").agg(F.sum("utility").alias("utility"), F.sum("support").alias("support"))
    return kept.withColumn("utility", F.round("utility", 6))


@query(f"""
    WITH {REC}, g AS (SELECT window_id, count(DISTINCT (pair_key, lang_idx)) AS n FROM rec GROUP BY 1) SELECT sum(n)::BIGINT AS unique_groups, sum(greatest(n - 500, 0))::BIGINT AS dropped FROM g""")
def admission_pressure(spark, d):
    return discovery.pressure(_observations(spark, d), 500)


@query(f"WITH {MERGED} SELECT pair_key * 30 + lang_idx AS composite_key, pair_key, lang_idx, support, round(probability_sum, 4) AS probability_sum FROM m")
def discovery_snapshot(spark, d):
    m = merged(spark, d)
    return m.select((F.col("pair_key") * 30 + F.col("lang_idx")).alias("composite_key"), "pair_key", "lang_idx", "support", F.round("probability_sum", 4).alias("probability_sum"))


@query(f"WITH {MERGED} SELECT pair_key, count(*) AS n_languages, string_agg(lang_idx::VARCHAR || ':' || support::VARCHAR, ',' ORDER BY lang_idx) AS languages FROM m GROUP BY 1")
def nested_languages(spark, d):
    n = discovery.with_languages(merged(spark, d))
    return n.select("pair_key", F.size("languages").cast("long").alias("n_languages"), F.array_join(F.transform("languages", lambda x: F.concat_ws(":", x["lang_idx"], x["support"])), ",").alias("languages"))


_ELIGIBLE = f"{ROLLED}, e AS (SELECT pair_key, round(utility, 6) AS utility, support FROM u WHERE round(utility, 6) > 0 AND round(utility, 6) >= 0.0002)"
_FREE = "f AS (SELECT * FROM e WHERE support >= 2 ORDER BY utility DESC, support DESC, pair_key LIMIT 3000)"
_HELD = f"""w AS (SELECT DISTINCT pair_key FROM (SELECT m.pair_key, row_number() OVER (PARTITION BY lang_idx ORDER BY round(m.utility, 6) DESC, m.support DESC, m.pair_key) AS rk
        FROM m JOIN e USING (pair_key) WHERE round(m.utility, 6) > 0 AND m.support >= 4) WHERE rk <= 100),
    h AS (SELECT e.*, true AS reserved FROM e JOIN w USING (pair_key) ORDER BY utility DESC, support DESC, pair_key LIMIT 3000),
    x AS (SELECT * FROM h UNION ALL SELECT e.*, false FROM e WHERE support >= 2 AND pair_key NOT IN (SELECT pair_key FROM h)),
    q AS (SELECT * FROM x ORDER BY reserved DESC, utility DESC, support DESC, pair_key LIMIT 3000)"""


@query(f"WITH {_ELIGIBLE}, {_FREE} SELECT pair_key, utility, support FROM f")
def promote_threshold(spark, d):
    return _rounded(selection.promote(merged(spark, d), 3000, 2, 0, 4, 0.0002)).select("pair_key", "utility", "support")


def _rounded(df):
    return df.withColumn("utility", F.round("utility", 6))


@query(f"WITH {_ELIGIBLE}, {_HELD} SELECT pair_key, utility, support, reserved FROM q")
def promote_quota(spark, d):
    return _rounded(selection.promote(merged(spark, d), 3000, 2, 100, 4, 0.0002))


@query(f"""
    WITH {_ELIGIBLE}, {_FREE}, {_HELD}, mem AS (SELECT pair_key, lang_idx FROM (SELECT m.pair_key, lang_idx, row_number() OVER (PARTITION BY lang_idx ORDER BY round(m.utility, 6) DESC, m.support DESC, m.pair_key) AS rk
        FROM m JOIN q USING (pair_key) WHERE round(m.utility, 6) > 0 AND m.support >= 4) WHERE rk <= 100)
    SELECT (SELECT round(sum(utility), 4) FROM f) AS global_utility, (SELECT round(sum(utility), 4) FROM q) AS reserved_utility, (SELECT count(*) FROM q) AS selected_pairs, (SELECT count(*) FROM q WHERE reserved) AS reserved_pairs,
    (SELECT count(*) / 524288.0 FROM m) AS saturation, (SELECT round(count(*) / (100.0 * (SELECT count(DISTINCT lang_idx) FROM m)), 9) FROM mem) AS occupancy, (SELECT count(*) FROM mem) AS memberships,
    (SELECT count(*) FROM q WHERE pair_key NOT IN (SELECT pair_key FROM f)) AS reservation_only, (SELECT count(*) FROM f WHERE pair_key NOT IN (SELECT pair_key FROM q)) AS global_only""")
def promotion_audit(spark, d):
    a = selection.audit(merged(spark, d), 3000, 2, 100, 4, 0.0002, capacity=524_288)
    return a.select("saturation", F.round("occupancy", 9).alias("occupancy"), "memberships", F.round("global_utility", 4).alias("global_utility"), F.round("reserved_utility", 4).alias("reserved_utility"), "selected_pairs", "reserved_pairs", "reservation_only", "global_only")


@query(f"""
    WITH {_ELIGIBLE}, {_HELD} SELECT pair_key, lang_idx FROM (SELECT m.pair_key, lang_idx, row_number() OVER (PARTITION BY lang_idx ORDER BY round(m.utility, 6) DESC, m.support DESC, m.pair_key) AS rk
    FROM m JOIN q USING (pair_key) WHERE round(m.utility, 6) > 0 AND m.support >= 4) WHERE rk <= 100""")
def reservation_memberships(spark, d):
    m = merged(spark, d)
    return selection.memberships(m, selection.promote(m, 3000, 2, 100, 4, 0.0002), 100, 4)


@query(f"""
    WITH {ROLLED}, k AS (SELECT left_id * 16384 + right_id AS pair_key, count(*) AS times FROM (SELECT token_id::BIGINT AS left_id, (token_id * 7) % 16384 AS right_id FROM vocab) GROUP BY 1 UNION ALL SELECT pair_key, 1 FROM u)
    SELECT k.pair_key, u.support, u.language_count, CASE WHEN times > 1 THEN 'repeated' WHEN u.support IS NULL THEN 'unknown_pair' WHEN round(utility, 6) <= 0 THEN 'nonpositive_utility' WHEN support < 3 THEN 'insufficient_support' END AS problem
    FROM (SELECT pair_key, sum(times) AS times FROM k GROUP BY 1) k LEFT JOIN u USING (pair_key)""")
def select_external(spark, d):
    v = read(spark, d, "vocab").select((F.col("token_id").cast("long") * 16384 + (F.col("token_id") * 7) % 16384).alias("pair_key"))
    m = merged(spark, d)
    keys = v.unionByName(m.select("pair_key").distinct())
    rounded = discovery.roll_up(m).select("pair_key", F.lit(0).alias("lang_idx"), F.round("utility", 6).alias("utility"), "probability_sum", "support", "positive_support", "language_count")
    out = selection.select_external(rounded, keys, 3).drop("language_count")
    return out.join(rounded.select("pair_key", "language_count"), "pair_key", "left").select("pair_key", "support", "language_count", "problem")


_STABLE = """CASE WHEN o.pair_key IS NOT NULL THEN 'already_exact' WHEN p.pair_key IS NULL THEN 'not_consecutive' WHEN c.u <= 0 OR p.u <= 0 THEN 'nonpositive_utility'
    WHEN c.n < 8 OR p.n < 8 THEN 'insufficient_support' WHEN c.ok = 0 OR p.ok = 0 THEN 'no_supported_positive_language' ELSE 'selected' END"""
_FROM = "FROM cu c LEFT JOIN pu p USING (pair_key) LEFT JOIN old o ON o.pair_key = c.pair_key"


def _stable(spark, d):
    prev, cur, old = halves(spark, d)
    return selection.stable_growth(prev, cur, old, 8, 4)


@query(f"WITH {HALVES} SELECT c.pair_key, {_STABLE} AS outcome {_FROM}")
def stable_growth(spark, d):
    return _stable(spark, d)


@query(f"""
    WITH {HALVES}, s AS (SELECT {_STABLE} AS outcome {_FROM}), r AS (SELECT unnest(['already_exact', 'not_consecutive', 'nonpositive_utility', 'insufficient_support', 'no_supported_positive_language', 'selected']) AS outcome)
    SELECT r.outcome, count(s.outcome) AS n FROM r LEFT JOIN s USING (outcome) GROUP BY 1""")
def rejection_histogram(spark, d):
    return selection.histogram(_stable(spark, d))


@query(f"""
    WITH {HALVES}, b AS (SELECT (SELECT count(*) FROM cu) AS hc, (SELECT count(*) FROM pu) AS hp)
    SELECT c.pair_key, CASE WHEN o.pair_key IS NOT NULL THEN 'already_exact' WHEN p.pair_key IS NULL THEN 'not_consecutive' WHEN c.u <= 0 OR p.u <= 0 THEN 'nonpositive_utility'
    WHEN c.n > 0 AND p.n > 0 AND c.pos / c.n - sqrt(ln(2.0 * greatest(hc, 1) / 0.05) / (2.0 * c.n)) > 0.5 AND p.pos / p.n - sqrt(ln(2.0 * greatest(hp, 1) / 0.05) / (2.0 * p.n)) > 0.5 THEN 'selected' ELSE 'insufficient_sign_evidence' END AS outcome
    {_FROM} CROSS JOIN b""")
def familywise_sign(spark, d):
    prev, cur, old = halves(spark, d)
    return selection.sign_growth(prev, cur, old)


_P = "greatest(least(c.ps / c.n, 1.0), 0.0)"


@query(f"""
    WITH {HALVES}, g AS (SELECT c.*, {_P} AS p FROM cu c)
    SELECT c.pair_key, CASE WHEN o.pair_key IS NOT NULL THEN 'already_exact' WHEN c.u <= 0 THEN 'nonpositive_utility' WHEN c.n < 8 THEN 'insufficient_support' WHEN c.ok = 0 THEN 'no_supported_positive_language'
    WHEN CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN 1 ELSE 1 / (1 + exp(-(ln(p / (1 - p)) - 2.0 / 3.0 * ln(0.1 / 1.1)))) END < 0.5 THEN 'gate_closed' ELSE 'selected' END AS outcome
    FROM g c LEFT JOIN old o USING (pair_key)""")
def l0_growth(spark, d):
    _, cur, old = halves(spark, d)
    return selection.l0_growth(cur, old, 8, 4)


@query()
def balanced_growth(spark, d):
    prev, cur, old = halves(spark, d)
    return selection.balanced_growth(prev, cur, old, 500, 2, 1).withColumn("share", F.round("share", 9))


@query(f"WITH {HALVES} SELECT c.pair_key, c.lang_idx, round(least(p.utility, c.utility), 6) AS least_utility FROM cur c JOIN prev p USING (pair_key, lang_idx) WHERE round(c.utility, 6) > 0 AND round(p.utility, 6) > 0")
def half_window_compare(spark, d):
    prev, cur, _ = halves(spark, d)
    both = cur.where("utility > 0").join(prev.where("utility > 0").select("pair_key", "lang_idx", F.col("utility").alias("before")), ["pair_key", "lang_idx"])
    return both.select("pair_key", "lang_idx", F.round(F.least("utility", "before"), 6).alias("least_utility"))


@query(f"WITH {HALVES} SELECT count(*) AS n, min(pair_key) AS least, max(pair_key) AS greatest FROM cu WHERE pair_key NOT IN (SELECT pair_key FROM old)")
def existing_antijoin(spark, d):
    _, cur, old = halves(spark, d)
    new = cur.select("pair_key").distinct().join(old, "pair_key", "left_anti")
    return new.agg(F.count("*").alias("n"), F.min("pair_key").alias("least"), F.max("pair_key").alias("greatest"))


@query(f"WITH {REC} SELECT (window_id // 5)::BIGINT AS window_id, pair_key, lang_idx, round(sum(utility), 6) AS utility, count(*) AS support FROM rec GROUP BY 1, 2, 3")
def step_window_reset(spark, d):
    out = windows.step_discovery(rec(spark, d).withColumnRenamed("window_id", "step"), 5)
    return out.withColumn("utility", F.round("utility", 6))


@query(f"""
    WITH {REC}, o AS (SELECT window_id, pair_key, lang_idx, sum(utility) AS u, sum(support)::BIGINT AS n FROM rec GROUP BY 1, 2, 3)
    SELECT window_id, pair_key, lang_idx, round(u, 6) AS utility, n AS support, round(sum(u) OVER w, 6) AS total_utility, (sum(n) OVER w)::BIGINT AS total_support FROM o WINDOW w AS (PARTITION BY pair_key, lang_idx ORDER BY window_id)""")
def diagnostic_windows(spark, d):
    out = lifecycle.diagnostic_windows(rec(spark, d))
    return out.select("window_id", "pair_key", "lang_idx", (F.round("utility", 6) + 0.0).alias("utility"), "support", (F.round("total_utility", 6) + 0.0).alias("total_utility"), "total_support")


@query(f"WITH {MERGED} SELECT pair_key, round(sum(utility), 6) + 0.0 AS utility, sum(support)::BIGINT AS support, count(*) AS languages, 0 AS problems FROM m GROUP BY 1")
def window_snapshot(spark, d):
    """A snapshot of all records as a resumed run would read it, with what its checks say."""
    snap = materialize(lifecycle.snapshot(rec(spark, d)))
    bad = lifecycle.snapshot_problems(snap, 30).where("problem <> 'number'")  # support may be 0 in these records
    bad = bad.groupBy("pair_key").agg(F.count("*").alias("problems"))
    out = snap.join(bad, "pair_key", "left").na.fill(0, ["problems"])
    return out.select("pair_key", (F.round("utility", 6) + 0.0).alias("utility"), "support", F.size("languages").cast("long").alias("languages"), F.col("problems").cast("int").alias("problems"))


# transitions: the vocabulary is what the threshold selector promotes
_SELECTED = f"{_ELIGIBLE}, {_FREE}, sel AS (SELECT pair_key, pair_key // 16384 AS l, pair_key % 16384 AS r FROM f)"
_SLOTTED = f"""{_SELECTED}, b AS (SELECT pair_key, abs(l * 2654435761 + r * 40503) % 4096 AS bucket FROM sel), n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY pair_key) AS rk FROM b),
    fr AS (SELECT range AS slot, row_number() OVER (ORDER BY range) AS k FROM range(4096) WHERE range NOT IN (SELECT bucket FROM b)), mv AS (SELECT *, row_number() OVER (ORDER BY pair_key) AS k FROM n WHERE rk > 1),
    sl AS (SELECT pair_key, bucket, bucket AS slot, false AS moved FROM n WHERE rk = 1 UNION ALL SELECT pair_key, bucket, fr.slot, true FROM mv LEFT JOIN fr USING (k))"""


def _selected(spark, d):
    return selection.promote(merged(spark, d), 3000, 2, 0, 4, 0.0002).select("pair_key")


@query(f"WITH {_SLOTTED} SELECT pair_key, bucket, slot, moved FROM sl")
def collision_slots(spark, d):
    return transitions.assign_slots(_selected(spark, d), 16384, 4096)


@query(f"WITH {_SLOTTED} SELECT pair_key, slot AS old_slot, row_number() OVER (ORDER BY pair_key) - 1 AS slot FROM sl")
def compact(spark, d):
    return transitions.compact(transitions.assign_slots(_selected(spark, d), 16384, 4096))


@query(f"""
    WITH {_SELECTED}, ex AS (SELECT pair_key, row_number() OVER (ORDER BY pair_key) - 1 AS slot FROM sel WHERE pair_key % 3 <> 0), a AS (SELECT pair_key, slot, false AS is_new FROM ex UNION ALL SELECT pair_key, NULL, true FROM sel WHERE pair_key % 3 = 0)
    SELECT pair_key, slot AS old_slot, row_number() OVER (ORDER BY pair_key) - 1 AS slot, is_new FROM a""")
def grow_merge(spark, d):
    s = _selected(spark, d)
    existing = transitions.compact(s.where("pair_key % 3 <> 0").withColumn("slot", F.lit(0).cast("long"))).select("pair_key", "slot")
    return transitions.grow(existing, s)


@query(f"""
    WITH {_SELECTED}, k AS (SELECT l, r, (l + r) * (l + r + 1) // 2 + r AS key FROM sel)
    SELECT l::INT AS "left", r::INT AS "right", key::BIGINT AS key, l || ' ' || r AS span, 'accepted' AS outcome, (16384 + row_number() OVER (ORDER BY key) - 1)::BIGINT AS token_id FROM k""")
def rule_generation(spark, d):
    """The first generation of merge rules, from the selected pairs."""
    s = _selected(spark, d).select((F.col("pair_key") - F.pmod("pair_key", F.lit(16384))).alias("_l"), F.pmod("pair_key", F.lit(16384)).cast("int").alias("right"))
    pairs = s.select((F.col("_l") / 16384).cast("int").alias("left"), "right")
    none = spark.createDataFrame([], "token_id int, left int, right int, generation int, active boolean, span array<int>")
    out = transitions.next_rules(none, 16384, pairs, 1)
    return out.select("left", "right", "key", F.array_join("span", " ").alias("span"), "outcome", F.col("token_id").cast("long").alias("token_id"))


@query(f"""
    WITH RECURSIVE {_SELECTED}, r0 AS (SELECT pair_key, l, r, 16384 + row_number() OVER (ORDER BY (l + r) * (l + r + 1) // 2 + r) - 1 AS token_id FROM sel),
    need AS (SELECT token_id, l, r FROM r0 WHERE token_id % 2 = 0 UNION SELECT r0.token_id, r0.l, r0.r FROM r0 JOIN need ON r0.token_id IN (need.l, need.r)) SELECT DISTINCT token_id FROM need""")
def ancestor_closure(spark, d):
    rules = rule_generation(spark, d).where("outcome = 'accepted'").select("token_id", "left", "right")
    return transitions.needed_rules(rules, rules.where("token_id % 2 = 0"), 1)
