"""Queries over the corpus: catalog, filters, samples, schedules, tokens and pairs of tokens."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import text as T
from ..config import StreamSettings, StreamSpec
from ..operators import filters, sampling, tokens
from ..sources import catalog
from ..storage import materialize, scratch
from ..streaming import windows
from . import stream
from .registry import query, read

#: Words of every script: letters with their marks, single letters where words are not spaced.
WORD_LIST = r"regexp_extract_all(regexp_replace(lower(text), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*)', ' \1 ', 'g'), '[\p{L}\p{M}]+')"
WORDS = f"t AS (SELECT doc_id, lang, {WORD_LIST} AS w FROM documents)"
LONG = f"{WORDS}, p AS (SELECT doc_id, lang, unnest(range(len(w))) AS pos, unnest(w) AS token FROM t)"
PAIRS = f"{LONG}, a AS (SELECT doc_id, lang, pos, token AS l, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM p), ab AS (SELECT * FROM a WHERE r IS NOT NULL)"
KEYS = "k AS (SELECT DISTINCT pair_key, pair_key // 16384 AS l, pair_key % 16384 AS r FROM window_records WHERE pair_key IS NOT NULL)"
STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"
ASCII = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"
TERMS = r"list_distinct(list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}]+'), lambda x: length(x) > 1))"


def docs(spark, d):
    return read(spark, d, "documents").select("doc_id", "lang", tokens.words("text").alias("tokens"))


def long(spark, d):
    return tokens.positions(docs(spark, d), "tokens", "doc_id", "lang")


def pair_keys(spark, d):
    k = read(spark, d, "window_records").where("pair_key IS NOT NULL").select("pair_key").distinct()
    return k.select("pair_key", K.key_left("pair_key", 16384).alias("l"), K.key_right("pair_key", 16384).alias("r"))


@query("""
    SELECT s.shard_id, s.source, s.path, coalesce(s.sampling_weight, 1.0) AS sampling_weight, coalesce(n.n_rows, 0) AS n_rows, coalesce(n.n_groups, 0) AS n_row_groups
    FROM shards s LEFT JOIN (SELECT shard_id, count(*) AS n_rows, count(DISTINCT row_group) AS n_groups FROM pairs GROUP BY 1) n USING (shard_id)""")
def pair_catalog(spark, d):
    counted = read(spark, d, "pairs").groupBy("shard_id").agg(F.count("*").alias("n_rows"), F.count_distinct("row_group").alias("n_row_groups"))
    out = read(spark, d, "shards").join(counted, "shard_id", "left").na.fill(0, ["n_rows", "n_row_groups"])
    return out.select("shard_id", "source", "path", F.coalesce("sampling_weight", F.lit(1.0)).alias("sampling_weight"), "n_rows", "n_row_groups")


@query(f"""
    WITH s AS (SELECT source, {STRIP.format('anchor')} AS a, {STRIP.format('positive')} AS p FROM pairs WHERE anchor IS NOT NULL AND positive IS NOT NULL)
    SELECT source, count(*) AS n, sum(length(a) + length(p))::BIGINT AS n_chars FROM s
    WHERE a <> '' AND p <> '' AND length(a) <= 512 AND length(p) <= 512 AND {ASCII.format('a')} <> {ASCII.format('p')} GROUP BY 1""")
def pair_filter_basic(spark, d):
    kept = filters.clean_pairs(read(spark, d, "pairs").select("source", "anchor", "positive"), exact=False)
    return kept.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.char_length("anchor") + F.char_length("positive")).alias("n_chars"))


@query(f"SELECT pair_id, {ASCII.format('anchor')} AS form FROM pairs WHERE {ASCII.format('anchor')} IS DISTINCT FROM {ASCII.format('positive')}")
def canonical_forms(spark, d):
    forms = read(spark, d, "pairs").select("pair_id", T.canonical_ascii("anchor").alias("form"), T.canonical_ascii("positive").alias("_p"))
    return forms.where(~F.col("form").eqNullSafe(F.col("_p"))).select("pair_id", "form")


#: Compatibility forms that occur in the texts: full-width ASCII and the ideographic space.
_WIDE_FROM, _WIDE_TO = "".join(map(chr, (*range(0xFF01, 0xFF5F), 0x3000))), "".join(map(chr, (*range(0x21, 0x7F), 0x20))).replace("'", "''")


def _canonical_sql(x: str) -> str:
    """NFKC, case folding and single spaces, as far as SQL has them."""
    folded = f"replace(replace(lower(nfc_normalize(translate({x}, '{_WIDE_FROM}', '{_WIDE_TO}'))), 'ς', 'σ'), 'ß', 'ss')"
    for c in map(chr, range(0xFB00, 0xFB05)):
        folded = f"replace({folded}, '{c}', '{unicodedata.normalize('NFKC', c)}')"
    return rf"trim(regexp_replace({folded}, '[\s\p{{Z}}]+', ' ', 'g'))"


@query(f"""
    WITH s AS (SELECT source, {STRIP.format('anchor')} AS a, {STRIP.format('positive')} AS p FROM pairs WHERE anchor IS NOT NULL AND positive IS NOT NULL)
    SELECT source, count(*) AS n FROM s WHERE a <> '' AND p <> '' AND length(a) <= 512 AND length(p) <= 512 AND {_canonical_sql('a')} <> {_canonical_sql('p')} GROUP BY 1""")
def canonical_filter(spark, d):
    """The same with the full canonical form, over pairs that pass the filters."""
    return filters.clean_pairs(read(spark, d, "pairs")).groupBy("source").agg(F.count("*").alias("n"))


@query(f"""
    WITH s AS (SELECT pair_id, {TERMS.format('anchor')} AS a, {TERMS.format('positive')} AS p FROM pairs WHERE anchor IS NOT NULL AND positive IS NOT NULL),
    x AS (SELECT pair_id, CASE WHEN len(a) + len(p) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a, p)) / (len(a) + len(p)) END AS dice FROM s)
    SELECT pair_id, round(dice, 9) AS dice FROM x WHERE dice > 0.3""")
def dice_overlap(spark, d):
    s = read(spark, d, "pairs").where("anchor IS NOT NULL AND positive IS NOT NULL").select("pair_id", T.word_terms("anchor").alias("a"), T.word_terms("positive").alias("p"))
    return filters.overlapping(s, "a", "p", 0.3).select("pair_id", F.round(T.dice("a", "p"), 9).alias("dice"))


def _terms_sql(x: str) -> str:
    letters = f"regexp_replace({_canonical_sql(x)}, '[^\\p{{L}}]', '', 'g')"
    pairs = f"list_distinct(CASE WHEN length({letters}) > 1 THEN list_transform(range(1, length({letters})), lambda i: substr({letters}, i::BIGINT, 2)) WHEN {letters} <> '' THEN [{letters}] ELSE [] END)"
    words = f"list_distinct(list_filter(regexp_extract_all({_canonical_sql(x)}, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+'), lambda w: length(w) > 1))"
    return f"CASE WHEN split_part(language_id, '_', 2) IN ('Hani', 'Hans', 'Hant', 'Jpan', 'Khmr', 'Laoo', 'Mymr', 'Thai') THEN {pairs} ELSE {words} END"


@query(f"""
    WITH s AS (SELECT pair_id, {_terms_sql('anchor')} AS a, {_terms_sql('positive')} AS p FROM pairs WHERE anchor IS NOT NULL AND positive IS NOT NULL)
    SELECT pair_id, round(CASE WHEN len(a) + len(p) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a, p)) / (len(a) + len(p)) END, 9) AS dice FROM s""")
def term_overlap(spark, d):
    """Overlap with terms by language: letter pairs where words are not spaced."""
    s = read(spark, d, "pairs").where("anchor IS NOT NULL AND positive IS NOT NULL")
    s = s.select("pair_id", T.terms("anchor", "language_id").alias("a"), T.terms("positive", "language_id").alias("p"))
    return s.select("pair_id", F.round(T.dice("a", "p"), 9).alias("dice"))


@query("SELECT source, count(*) FILTER (length(anchor) <= 80 AND length(positive) <= 80) AS n_short, count(*) AS n FROM pairs GROUP BY 1")
def length_cap(spark, d):
    return read(spark, d, "pairs").groupBy("source").agg(F.count_if((F.char_length("anchor") <= 80) & (F.char_length("positive") <= 80)).alias("n_short"), F.count("*").alias("n"))


@query("""
    WITH s AS (SELECT pair_id, anchor, CASE WHEN coalesce(anchor_language_id, '') = '' THEN language_id ELSE anchor_language_id END AS lang FROM pairs)
    SELECT pair_id, CASE WHEN lang IS NULL OR regexp_matches(anchor, '^__[a-z]{3}_[A-Za-z]{4}__ ') THEN anchor ELSE '__' || lang || '__ ' || anchor END AS marked FROM s""")
def marker_projection(spark, d):
    lang = F.when(F.coalesce("anchor_language_id", F.lit("")) == "", F.col("language_id")).otherwise(F.col("anchor_language_id"))
    return read(spark, d, "pairs").select("pair_id", T.with_marker("anchor", lang).alias("marked"))


@query("SELECT lang, count(*) AS n FROM documents WHERE (lang IN ('eng_Latn') OR lower(split_part(lang, '_', 1)) IN ('fra', 'deu', 'rus')) AND NOT (lang IN ('deu_Latn')) GROUP BY 1")
def lang_include_exclude(spark, d):
    return read(spark, d, "documents").where(filters.languages_kept("lang", ["eng_Latn", "fra", "deu", "rus"], ["deu_Latn"])).groupBy("lang").agg(F.count("*").alias("n"))


@query()
def in_batch_dedup(spark, d):
    """Batches of 64 within each row group, in the order of its rows."""
    pairs = read(spark, d, "pairs").withColumn("block", F.concat_ws("-", "shard_id", "row_group"))
    return filters.batch_dedup(pairs.select("pair_id", "anchor", "positive", "block"), 64, "block", "pair_id").select("block", "batch", "slot", "pair_id")


@query("""
    WITH f AS (SELECT source, lang, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE lang <> '' GROUP BY 1, 2),
    l AS (SELECT lang, sum(bytes)::BIGINT AS total FROM f GROUP BY 1 ORDER BY total DESC, lang LIMIT 8),
    w AS (SELECT source, lang, bytes * pow(total, 0.7 - 1.0) AS raw FROM f JOIN l USING (lang))
    SELECT source, lang, round(raw / max(raw) OVER (), 9) AS weight FROM w""")
def language_temperature_weights(spark, d):
    f = read(spark, d, "documents").where("lang <> ''").groupBy("source", "lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    return sampling.language_weights(f, 0.7, 8, language="lang").select("source", "lang", F.round("weight", 9).alias("weight"))


_GROUPS = "g AS (SELECT source, language_id AS language, count(*) AS rows FROM pairs WHERE source IS NOT NULL AND coalesce(language_id, '') <> '' GROUP BY 1, 2), s AS (SELECT source, avg(coalesce(sampling_weight, 1.0)) AS source_weight FROM shards GROUP BY 1)"


def _groups(spark, d):
    g = read(spark, d, "pairs").where("source IS NOT NULL AND language_id <> ''").groupBy("source", F.col("language_id").alias("language")).agg(F.count("*").alias("rows"))
    return g.join(read(spark, d, "shards").groupBy("source").agg(F.avg(F.coalesce("sampling_weight", F.lit(1.0))).alias("source_weight")), "source")


@query(f"""
    WITH {_GROUPS}, x AS (SELECT *, pow(rows, 0.5) / sum(pow(rows, 0.5)) OVER (PARTITION BY source) AS share, source_weight * pow(sum(rows) OVER (PARTITION BY source), 0.5) AS mass FROM g JOIN s USING (source)),
    m AS (SELECT sum(mass) AS total FROM (SELECT DISTINCT source, mass FROM x))
    SELECT source, language, round(share * mass / total, 9) AS weight FROM x, m""")
def group_weights(spark, d):
    return sampling.group_weights(_groups(spark, d), 0.5, 0.5).select("source", "language", F.round("weight", 9).alias("weight"))


def _schedule_sql(batches: str) -> str:
    """Due times of the turns of sources, and of the languages of each; ``batches``: how many turns, of one row ``n``."""
    return f"""{_GROUPS}, b AS ({batches}), gs AS (SELECT source, language, rows, source_weight FROM g JOIN s USING (source) WHERE source_weight > 0),
    so AS (SELECT source, max(source_weight) * pow(sum(rows), 0.5) AS w FROM gs GROUP BY 1), ss AS (SELECT source, w / sum(w) OVER () AS share FROM so),
    ot AS (SELECT source, share, unnest(range((ceil((n + 2) * share) + 2)::BIGINT)) AS turn FROM ss, b), oo AS (SELECT source, turn, row_number() OVER (ORDER BY round((turn + 0.5) / share, 6), md5('0|' || source)) - 1 AS batch FROM ot),
    o AS (SELECT oo.* FROM oo, b WHERE batch < n), ln AS (SELECT source, max(turn) + 1 AS m FROM o GROUP BY 1),
    li AS (SELECT source, language, pow(rows, 0.5) / sum(pow(rows, 0.5)) OVER (PARTITION BY source) AS share FROM gs), lt AS (SELECT source, language, share, unnest(range((ceil((m + 2) * share) + 2)::BIGINT)) AS turn FROM li JOIN ln USING (source)),
    lo AS (SELECT source, language, turn, row_number() OVER (PARTITION BY source ORDER BY round((turn + 0.5) / share, 6), md5('0|' || language)) - 1 AS place FROM lt),
    plan AS (SELECT batch, o.source, language, lo.turn AS occurrence FROM o JOIN lo ON lo.source = o.source AND lo.place = o.turn)"""


@query(f"WITH {_schedule_sql('SELECT 5000 AS n')} SELECT * FROM plan")
def smooth_schedule(spark, d):
    """A plan of 5,000 batches."""
    return sampling.batch_plan(_groups(spark, d), 5_000, 0, 0.5, 0.5)


@query(f"WITH {_schedule_sql('SELECT 5000 AS n')} SELECT * FROM plan WHERE batch >= 4000")
def resumed_schedule(spark, d):
    """The last fifth of the same plan, made without what comes before."""
    return sampling.batch_plan(_groups(spark, d), 1_000, 4_000, 0.5, 0.5)


_WHOLE_PLAN = _schedule_sql("SELECT count(*) // 32 AS n FROM pairs")


def _full_plan(spark, d):
    """As many batches of 32 as the pairs fill."""
    return materialize(sampling.batch_plan(_groups(spark, d), read(spark, d, "pairs").count() // 32, 0, 0.5, 0.5))


def _grouped_pairs(spark, d):
    return read(spark, d, "pairs").select("pair_id", "source", F.col("language_id").alias("language"), "anchor", "positive")


@query(f"""
    WITH {_WHOLE_PLAN}, w AS (SELECT source, language, max(occurrence) AS last FROM plan GROUP BY 1, 2),
    r AS (SELECT pair_id, source, language_id AS language, rows AS n, unnest(range(((last + 1) * 32 - 1) // rows + 1)) AS pass FROM pairs p JOIN g USING (source) JOIN w USING (source, language) WHERE p.language_id = g.language),
    q AS (SELECT *, pass * n + row_number() OVER (PARTITION BY source, language, pass ORDER BY md5('0|' || pass || '|' || pair_id), pair_id) - 1 AS place FROM r)
    SELECT batch, (place % 32)::INT AS slot, source, language, pair_id FROM q JOIN plan USING (source, language) WHERE plan.occurrence = place // 32""")
def homogeneous_batches(spark, d):
    out = sampling.homogeneous_batches(_grouped_pairs(spark, d).drop("anchor", "positive"), _full_plan(spark, d), 32, "pair_id")
    return out.select("batch", "slot", "source", "language", "pair_id")


@query()
def unique_batches(spark, d):
    """The same batches without a text that comes twice in one."""
    return sampling.unique_batches(_grouped_pairs(spark, d), _full_plan(spark, d), 32, "pair_id").select("batch", "slot", "source", "language", "pair_id")


@query("""
    WITH c AS (SELECT source, count(*) AS n FROM pairs WHERE source IS NOT NULL GROUP BY 1), k AS (SELECT sum(n)::BIGINT AS total FROM c), w AS (SELECT source, n, sqrt(n) / sum(sqrt(n)) OVER () AS share FROM c),
    t AS (SELECT source, n, share, unnest(range((ceil((total + 2) * share) + 2)::BIGINT)) AS turn FROM w, k), o AS (SELECT source, n, turn, row_number() OVER (ORDER BY round((turn + 0.5) / share, 6), md5('0|' || source)) - 1 AS place FROM t),
    l AS (SELECT source, max(turn) // max(n) AS last FROM o, k WHERE place < total GROUP BY 1), r AS (SELECT pair_id, source, unnest(range(last + 1)) AS pass FROM pairs JOIN l USING (source)),
    q AS (SELECT source, pair_id, pass, row_number() OVER (PARTITION BY source, pass ORDER BY md5('0|' || pass || '|' || pair_id), pair_id) - 1 AS at FROM r)
    SELECT place, o.source, pair_id FROM o JOIN q ON q.source = o.source AND q.pass = turn // n AND q.at = turn % n, k WHERE place < total""")
def mixed_stream(spark, d):
    """As many places of the mixture as there are pairs, sources by the root of their rows."""
    rows = read(spark, d, "pairs").where("source IS NOT NULL").select("pair_id", "source")
    weights = rows.groupBy("source").agg(F.sqrt(F.count("*").cast("double")).alias("weight"))
    return sampling.mixed_order(rows, weights, "pair_id", rows.count()).select("place", "source", "pair_id")


@query("SELECT pair_id, shard_id, row_group FROM (SELECT *, row_number() OVER (PARTITION BY shard_id, row_group ORDER BY md5('7|' || pair_id), pair_id) AS rk FROM pairs) WHERE rk <= 20")
def hash_sample(spark, d):
    return sampling.sample_rows(read(spark, d, "pairs").select("pair_id", "shard_id", "row_group"), 20, ["shard_id", "row_group"], "pair_id", 7)


@query("SELECT shard_id, source, (row_number() OVER (ORDER BY md5('7|3|' || shard_id), shard_id) - 1)::INT AS place FROM shards")
def shard_deck(spark, d):
    return sampling.deck(read(spark, d, "shards").select("shard_id", "source"), "shard_id", 3, 7)


@query("""
    SELECT shard_id, sampling_weight FROM shards WHERE sampling_weight > 0
    ORDER BY -ln(('0x' || left(md5('7|' || shard_id), 12))::BIGINT / 281474976710656.0::DOUBLE + 0.5 / 281474976710656.0::DOUBLE) / sampling_weight, shard_id LIMIT 50""")
def weighted_shards(spark, d):
    return sampling.weighted_draws(read(spark, d, "shards").select("shard_id", "sampling_weight"), "shard_id", "sampling_weight", 50, 7)


@query("""
    WITH g AS (SELECT shard_id, row_group, count(*) AS rows FROM pairs GROUP BY 1, 2)
    SELECT g.shard_id, row_group, rows, round(coalesce(sampling_weight, 1.0) * rows / sum(rows) OVER (PARTITION BY g.shard_id), 9) AS weight FROM g JOIN shards USING (shard_id)""")
def fragment_weights(spark, d):
    g = read(spark, d, "pairs").groupBy("shard_id", "row_group").agg(F.count("*").alias("rows"))
    g = g.join(read(spark, d, "shards").select("shard_id", F.coalesce("sampling_weight", F.lit(1.0)).alias("sampling_weight")), "shard_id")
    return sampling.fragment_weights(g).select("shard_id", "row_group", "rows", F.round("weight", 9).alias("weight"))


@query("""
    WITH g AS (SELECT DISTINCT shard_id, row_group FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY row_group DESC) AS back, count(*) OVER (PARTITION BY shard_id) AS n FROM g)
    SELECT p.shard_id, count(*) FILTER (n > 2 AND back <= 2) AS held, count(*) FILTER (NOT (n > 2 AND back <= 2)) AS kept
    FROM pairs p JOIN r ON p.shard_id = r.shard_id AND p.row_group = r.row_group GROUP BY 1""")
def holdout_split(spark, d):
    rows = sampling.holdout(read(spark, d, "pairs").select("shard_id", "row_group"), 2)
    return rows.groupBy("shard_id").agg(F.count_if("held_out").alias("held"), F.count_if(~F.col("held_out")).alias("kept"))


@query("""
    SELECT pair_id FROM (SELECT pair_id, row_number() OVER (PARTITION BY shard_id, row_group, row_index ORDER BY ingested_at, pair_id) AS rk FROM pairs) WHERE rk = 1""")
def first_delivery(spark, d):
    """Of rows delivered again, the first."""
    return filters.first_of_key(read(spark, d, "pairs"), ["shard_id", "row_group", "row_index"], [F.asc("ingested_at"), F.asc("pair_id")]).select("pair_id")


@query(f"WITH {LONG} SELECT doc_id, pos, token FROM p")
def token_positions(spark, d):
    return long(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


@query(f"WITH {WORDS}, c AS (SELECT doc_id, len(w) AS n FROM t WHERE len(w) > 0) SELECT doc_id, n AS n_tokens, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS start FROM c")
def sentence_layout(spark, d):
    return tokens.layout(long(spark, d), "doc_id")


@query(f"WITH {PAIRS} SELECT l AS \"left\", r AS \"right\", lang, count(*) AS n FROM ab GROUP BY ALL")
def adjacent_pairs(spark, d):
    return tokens.adjacent_pairs(docs(spark, d), "tokens", "lang").groupBy("left", "right", "lang").agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS} SELECT l AS \"left\", r AS \"right\", count(*) AS support FROM ab GROUP BY ALL ORDER BY support DESC, 1, 2 LIMIT 1000")
def frequency_topk(spark, d):
    n = tokens.adjacent_pairs(docs(spark, d), "tokens").groupBy("left", "right").agg(F.count("*").alias("support"))
    return n.orderBy(F.desc("support"), "left", "right").limit(1000)


@query(f"WITH {PAIRS}, g AS (SELECT l, r, lead(r) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM ab) SELECT l || ' ' || r || ' ' || s AS gram, count(*) AS n FROM g WHERE s IS NOT NULL GROUP BY 1")
def ngrams3(spark, d):
    return tokens.ngrams(docs(spark, d), "tokens", 3).select(F.array_join("gram", " ").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS} SELECT l || ' ' || r AS gram, lang, count(*) AS n FROM ab GROUP BY ALL")
def ngrams2(spark, d):
    return tokens.ngrams(docs(spark, d), "tokens", 2, "lang").select("lang", F.array_join("gram", " ").alias("gram")).groupBy("gram", "lang").agg(F.count("*").alias("n"))


@query(f"""
    WITH {LONG}, o AS (SELECT doc_id, pos, sum((length(token) >= 4)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM p)
    SELECT doc_id, (max(s) - min(s) + 1)::BIGINT AS n_words FROM o GROUP BY 1""")
def word_ids(spark, d):
    w = tokens.word_ids(long(spark, d), "doc_id", F.length("token") >= 4)
    return w.groupBy("doc_id").agg((F.max("word") + 1).alias("n_words"))


@query(f"""
    WITH {LONG}, c AS (SELECT doc_id, pos, length(token) <= 3 AS cand, lag(length(token) <= 3) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM p),
    s AS (SELECT *, max(CASE WHEN cand AND NOT coalesce(before, false) THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS start FROM c)
    SELECT doc_id, count(*) FILTER (cand AND (pos - start) % 2 = 0) AS n_kept FROM s GROUP BY 1""")
def leftmost_nonoverlap(spark, d):
    c = tokens.leftmost(long(spark, d).withColumn("cand", F.length("token") <= 3), "doc_id", "cand")
    return c.groupBy("doc_id").agg(F.count_if("keep").alias("n_kept"))


@query(f"WITH {WORDS.replace('t AS', 'p AS', 1)} SELECT doc_id, len(list_filter(w, lambda x: x NOT IN ('the', 'a', 'de', 'la')))::BIGINT AS n FROM p")
def ignored_tokens(spark, d):
    return tokens.drop_tokens(docs(spark, d), "tokens", ["the", "a", "de", "la"]).select("doc_id", F.size("tokens").cast("long").alias("n"))


@query("""
    SELECT l.lang_idx, count(*) AS n_docs FROM documents d JOIN languages l ON d.lang = l.lang_code GROUP BY 1
    UNION ALL SELECT -1, count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM languages l WHERE d.lang = l.lang_code)""")
def marker_split(spark, d):
    marked = read(spark, d, "documents").select(F.concat(F.array(T.marker_for(F.coalesce("lang", F.lit("und")))), tokens.words("text")).alias("tokens"))
    markers = read(spark, d, "languages").select(T.marker_for("lang_code").alias("marker"), "lang_idx")
    return tokens.split_markers(marked, "tokens", markers).groupBy("lang_idx").agg(F.count("*").alias("n_docs"))


@query(f"""
    WITH {PAIRS} SELECT (a.token_id::BIGINT * 16384 + b.token_id) AS pair_key, count(*) AS n FROM ab JOIN vocab a ON ab.l = a.piece JOIN vocab b ON ab.r = b.piece GROUP BY 1""")
def pair_key_exact(spark, d):
    v = read(spark, d, "vocab")
    n = tokens.adjacent_pairs(docs(spark, d), "tokens").groupBy("left", "right").agg(F.count("*").alias("n"))  # counted before it is joined
    n = n.join(v.select(F.col("piece").alias("left"), F.col("token_id").alias("a")), "left").join(v.select(F.col("piece").alias("right"), F.col("token_id").alias("b")), "right")
    return n.select(K.pair_key("a", "b", 16384).alias("pair_key"), "n")


@query(f"WITH {KEYS} SELECT pair_key, abs(l * 2654435761 + r * 40503) % 262144 AS bucket FROM k")
def pair_hash(spark, d):
    return pair_keys(spark, d).select("pair_key", K.pair_hash("l", "r", 262144).alias("bucket"))


_WRAP = "(CASE WHEN ((({0}) % 18446744073709551616::HUGEINT) + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT >= 9223372036854775808::HUGEINT THEN ((({0}) % 18446744073709551616::HUGEINT) + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT - 18446744073709551616::HUGEINT ELSE ((({0}) % 18446744073709551616::HUGEINT) + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT END)"


@query(f"""
    WITH {KEYS}, a AS (SELECT *, {_WRAP.format('l::HUGEINT * 40503')} AS v FROM k), b AS (SELECT *, {_WRAP.format('v::HUGEINT * 2654435761 + r * 40503 + 1')} AS w FROM a),
    c AS (SELECT pair_key, {_WRAP.format('w::HUGEINT * 2654435761 + l * 40503 + 2')} AS x FROM b) SELECT pair_key, (abs(x) % 65536)::BIGINT AS bucket FROM c""")
def ngram_hash3(spark, d):
    return pair_keys(spark, d).select("pair_key", K.ngram_hash(["l", "r", "l"], 65536).alias("bucket"))


@query(f"WITH {KEYS} SELECT pair_key, ((l + r) * (l + r + 1) // 2 + r)::BIGINT AS cantor, l AS \"left\", r AS \"right\" FROM k")
def cantor_roundtrip(spark, d):
    k = pair_keys(spark, d).withColumn("cantor", K.cantor_key("l", "r"))
    return k.select("pair_key", "cantor", K.cantor_left("cantor").alias("left"), K.cantor_right("cantor").alias("right"))


@query(f"""
    WITH {KEYS} SELECT pair_key, (({_WRAP.format('pair_key::HUGEINT * 6364136223846793005 + 1442695040888963407')} % 524288 + 524288) % 524288)::BIGINT AS bucket0,
    (({_WRAP.format('pair_key::HUGEINT * 3935559000370003845 + 4768777513237032717')} % 524288 + 524288) % 524288)::BIGINT AS bucket2,
    ((pair_key % 2 + 1) % 2)::INT * 2 - 1 AS sign0 FROM k""")
def sketch_cells(spark, d):
    return pair_keys(spark, d).select("pair_key", K.sketch_bucket("pair_key", 0, 524288).alias("bucket0"), K.sketch_bucket("pair_key", 2, 524288).alias("bucket2"), K.sketch_sign("pair_key", 0).alias("sign0"))


#: Labels that no shard may have: each that is renamed, some that are not.
_SUITE = ("ara-Arab", "aze_Latn", "cmn_Hans", "cmn_Hant", "est_Latn", "fas_Arab", "jpn_Hira", "kor_Kore", "kur_Arab", "kur_Latn", "lav_Latn", "mon_Cyrl", "msa_Latn", "nep_Deva", "nor_Latn", "pes_Arab", "rom_Latn", "sqi_Latn", "swa_Latn", "tgl_Latn", "uzb-Latn", "zho-Hans", "zho_Hant")
# What the suites' labels stand for, written out a second time so that the query is not checked against itself.
_RENAMED = "('ara_Arab', 'arb_Arab'), ('aze_Latn', 'azj_Latn'), ('cmn_Hans', 'cmn_Hani'), ('cmn_Hant', 'cmn_Hani'), ('est_Latn', 'ekk_Latn'), ('jpn_Hira', 'jpn_Jpan'), ('kor_Kore', 'kor_Hang'), ('kur_Arab', 'ckb_Arab'), ('kur_Latn', 'kmr_Latn'), ('lav_Latn', 'lvs_Latn'), ('mon_Cyrl', 'khk_Cyrl'), ('msa_Latn', 'zsm_Latn'), ('nep_Deva', 'npi_Deva'), ('nor_Latn', 'nob_Latn'), ('pes_Arab', 'fas_Arab'), ('rom_Latn', 'rmy_Latn'), ('sqi_Latn', 'als_Latn'), ('swa_Latn', 'swh_Latn'), ('tgl_Latn', 'fil_Latn'), ('zho_Hans', 'cmn_Hani'), ('zho_Hant', 'cmn_Hani')"


@query(f"""
    WITH a(label, renamed) AS (VALUES {_RENAMED}), n AS (SELECT shard_id::BIGINT AS id, path, coalesce(language_id, '') AS lang FROM shards UNION ALL SELECT -1, x, x FROM (SELECT unnest({list(_SUITE)}) AS x))
    SELECT id, coalesce(renamed, replace(lang, '-', '_')) AS language, regexp_replace(path, '[^A-Za-z0-9._-]', '_', 'g') AS slug, lower(split_part(lang, '_', 1)) AS code FROM n LEFT JOIN a ON label = replace(lang, '-', '_')""")
def language_alias(spark, d):
    labels = read(spark, d, "shards").select(F.col("shard_id").cast("long").alias("id"), "path", F.coalesce("language_id", F.lit("")).alias("lang"))
    suite = spark.createDataFrame([(-1, x, x) for x in _SUITE], "id long, path string, lang string")
    return labels.unionByName(suite).select("id", T.eval_language("lang").alias("language"), T.safe_slug("path").alias("slug"), T.language_code("lang").alias("code"))


@query("SELECT item_id, coalesce(lower(lang) IN ('jpn-jpan', 'jpn', 'ja', 'jp', 'fra_latn') OR len(list_intersect(string_split(replace(lower(lang), '_', '-'), '-'), ['jpn', 'ja', 'jp', 'fra'])) > 0, false) AS named FROM eval_items")
def subset_language_match(spark, d):
    return read(spark, d, "eval_items").select("item_id", T.names_language(F.array("lang"), ["jpn", "FRA"]).alias("named"))


def _spec():
    return StreamSpec(name="pairs", root="tables", parquet="pairs.parquet", anchor_column="anchor", positive_column="positive", language_id="", weight=2.0)


@query("SELECT 'pairs' AS source, count(*) AS usable_rows, 2.0::DOUBLE AS sampling_weight, '' AS language_id FROM pairs")
def discovered_shards(spark, d):
    """The files of one stream as ``catalog.discover`` lists them, with rows from their footers."""
    return catalog.discover(spark, [_spec()], {"tables": d}).select("source", "usable_rows", "sampling_weight", "language_id")


@query("SELECT 'pairs.parquet' AS file, count(*) AS n, count(anchor) AS anchors, sum(length(positive))::BIGINT AS n_chars, max(row_index_)::BIGINT AS last FROM (SELECT *, row_number() OVER () - 1 AS row_index_ FROM pairs)")
def scanned_pairs(spark, d):
    paths = [r["path"] for r in catalog.discover(spark, [_spec()], {"tables": d}).collect()]  # a catalog
    rows = catalog.scan(spark, paths, "anchor", "positive")
    return rows.groupBy(F.element_at(F.split("path", "/"), -1).alias("file")).agg(F.count("*").alias("n"), F.count("anchor").alias("anchors"), F.sum(F.char_length("positive")).alias("n_chars"), F.max("row_index").alias("last"))


@query()
def training_batches(spark, d):
    """The whole way from files to batches of 64: catalog, scan, filters, schedule, batches without a text twice."""
    n = read(spark, d, "pairs").count() // 64
    return stream.training_batches(spark, [_spec()], {"tables": d}, StreamSettings(batch_size=64), n).select("batch", "slot", "source", "row_id")


@query()
def stream_dedup(spark, d):
    """Pairs as a stream, by source, without repeated texts in batches of 64; read back when it has ended."""
    out = scratch(spark, "stream")
    pairs = spark.readStream.schema(read(spark, d, "pairs").schema).parquet(f"{d}/pairs.parquet*").where("source IS NOT NULL")
    run = windows.stream_dedup(pairs.select("source", "anchor", "positive"), 64, "source").writeStream.foreachBatch(windows.exactly_once(f"{out}/data", lambda df: df.withColumnRenamed("batch", "number")))
    run.option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data").groupBy("source", F.col("number").alias("batch")).agg(F.count("*").alias("n"), F.count_distinct("anchor").alias("anchors"))
