"""Queries of this subpackage, each (spark, sf_dir) -> DataFrame over whole tables, and their SQL where there is one."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import heavy_hitters, langid, leaks, lookalikes, mixing, packing, scripts, token_budget, truncation
from ._common import materialize, read
from .sizes import with_sizes

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_hitters.top_items(read(spark, sf_dir, "window_records"), "pair_key", "support", "record_id", 60).select(F.col("item").alias("pair_key"))


def p1_top_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same keys with their support and rank."""
    top = heavy_hitters.top_items(read(spark, sf_dir, "window_records"), "pair_key", "support", "record_id", 60)
    rank = F.row_number().over(Window.orderBy(F.desc("weight"), "item"))  # of 60 rows
    return top.select(F.col("item").alias("pair_key"), F.col("weight").alias("support"), rank.cast("long").alias("rank"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(read(spark, sf_dir, "pairs"), read(spark, sf_dir, "eval_items"))


def p2_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity matches: passages of which up to two words of ten differ or stand up to two places off."""
    return leaks.near(materialize(leaks.index(read(spark, sf_dir, "pairs"))), read(spark, sf_dir, "eval_items"))


def p2_leaks_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "pairs")
    found = materialize(leaks.leaked(pairs, read(spark, sf_dir, "eval_items")))
    return leaks.leaks_by_source(found, pairs)


def _anchor_label():
    return F.when(F.coalesce("anchor_language_id", F.lit("")) == "", F.col("language_id")).otherwise(F.col("anchor_language_id"))


def p3_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes of documents and of anchors in one table; ``corpus`` tells which. Labels are read, however they are spelled.

    ``n_first_texts`` and ``n_first_tokens`` leave out rows of pairs that were delivered again; documents have no such rows.
    """
    vocab, languages = read(spark, sf_dir, "vocab"), read(spark, sf_dir, "languages")
    docs = token_budget.count_tokens(read(spark, sf_dir, "documents").select("source", "lang", "web_domain", "text"), "text", vocab)
    docs = token_budget.with_language(docs, "lang", languages).withColumn("n_first", F.col("n_tokens"))
    docs = token_budget.token_cube(docs, "source", "lang", "web_domain", first="n_first").select(F.lit("documents").alias("corpus"), "*")
    delivery = ["shard_id", "row_group", "row_index"]
    pairs = token_budget.count_tokens(read(spark, sf_dir, "pairs").select("pair_id", "source", _anchor_label().alias("lang"), *delivery, "anchor"), "anchor", vocab)
    pairs = materialize(token_budget.with_language(pairs, "lang", languages))
    pairs = token_budget.first_tokens(pairs, delivery, "pair_id")
    pairs = token_budget.token_cube(pairs, "source", "lang", first="n_first").withColumn("web_domain", F.lit(None).cast("string"))
    return docs.unionByName(pairs.select(F.lit("pairs").alias("corpus"), "*"))


def p3_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_budget.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", read(spark, sf_dir, "vocab"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.equal_looking(lookalikes.sides_of(read(spark, sf_dir, "pairs")))


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value and its one form: (pair_id, side, value, canonical)."""
    return lookalikes.canonical_forms(lookalikes.sides_of(read(spark, sf_dir, "pairs")))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``p4_found`` in the form for any size: one row per row, with its class and its number of links."""
    return lookalikes.look_classes(lookalikes.sides_of(read(spark, sf_dir, "pairs")))


def _profiles(spark: SparkSession, sf_dir: str) -> langid.Profiles:
    return langid.fit(read(spark, sf_dir, "lang_samples"), read(spark, sf_dir, "documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = langid.text_languages(read(spark, sf_dir, "pairs"), _profiles(spark, sf_dir), read(spark, sf_dir, "languages"), "pair_id", "anchor", _anchor_label())
    return langid.wrong_labels(judged)


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each anchor with its language, a confidence and all languages of its sentences."""
    judged = langid.text_languages(read(spark, sf_dir, "pairs"), _profiles(spark, sf_dir), read(spark, sf_dir, "languages"), "pair_id", "anchor", _anchor_label())
    return judged.select("pair_id", "lang", F.round("confidence", 6).alias("confidence"), "langs", "label", "label_code")


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.segment_languages(read(spark, sf_dir, "pairs"), _profiles(spark, sf_dir)).select("pair_id", "part", "text", "lang", F.round("confidence", 6).alias("confidence"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = with_sizes(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", terms="terms")
    return packing.pack(sized, read(spark, sf_dir, "pack_limits"))


def p6_fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_rates(p6_containers(spark, sf_dir))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_sizes(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_sized(spark, sf_dir), read(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached, and which source binds the budget."""
    sized, targets = materialize(_sized(spark, sf_dir)), read(spark, sf_dir, "mix_targets")
    return mixing.shares_reached(mixing.mix(sized, targets), targets, sized)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.judged(read(spark, sf_dir, "documents")).select("doc_id")


def p8_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents with what gave each away."""
    return truncation.judged(read(spark, sf_dir, "documents"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return truncation.truncation_rates(docs, truncation.judged(docs))


def p8_prefix_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.prefix_links(read(spark, sf_dir, "documents"))


def p8_anchor_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join over anchors of pairs, where short texts begin longer ones more often."""
    return truncation.prefix_links(read(spark, sf_dir, "pairs").select(F.col("pair_id").alias("doc_id"), F.col("anchor").alias("text")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_top_support, p2_found, p2_near, p2_leaks_by_source, p3_token_totals, p3_document_tokens, p4_found, p4_canonical, p4_classes, p5_found, p5_languages, p5_segments,
        p6_containers, p6_fill_rates, p7_mixture, p7_shares, p8_found, p8_routes, p8_rates, p8_prefix_copies, p8_anchor_prefixes,
    )
}

_TOP = """
    SELECT pair_key, sum(support)::BIGINT AS support
    FROM (SELECT record_id, pair_key, min(support) AS support FROM window_records WHERE pair_key IS NOT NULL AND support IS NOT NULL GROUP BY 1, 2)
    GROUP BY pair_key ORDER BY support DESC, pair_key LIMIT 60"""



def _look_sql() -> str:
    """The look of ``value`` in SQL, from a fixed list of letters in place of the table of confusable characters."""
    one = {c: p for c, p in lookalikes.width_forms().items() if len(p) == 1} | {c: p for c, p in scripts.LOOK_ALIKES.items() if c != "ı"} | dict.fromkeys(lookalikes.SPACES, " ")
    accented = {c: unicodedata.normalize("NFC", scripts.LOOK_ALIKES[d[0]] + d[1:]) for c in map(chr, (*range(0x370, 0x530), *range(0x1F00, 0x2000))) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0] in scripts.LOOK_ALIKES}
    one |= {c: p for c, p in accented.items() if len(p) == 1}
    to = "".join(one.values()).replace("'", "''")
    out = f"translate(value, '{''.join(one)}{lookalikes.HIDDEN}', '{to}')"
    for c, p in lookalikes.width_forms().items():
        if 0xFB00 <= ord(c) <= 0xFB06:
            out = f"replace({out}, '{c}', '{p}')"
    return f"nfc_normalize({out})"


_LOOKS = f"""v AS (SELECT pair_id, 'anchor' AS side, anchor AS value FROM pairs UNION ALL SELECT pair_id, 'positive', positive FROM pairs),
    l AS (SELECT pair_id, side, value, CASE WHEN value <> '' THEN {_look_sql()} END AS look FROM v), c AS (SELECT side, look, value, count(*) AS n FROM l WHERE look IS NOT NULL GROUP BY ALL),
    k AS (SELECT *, first_value(value) OVER (PARTITION BY side, look ORDER BY n DESC, value) AS canonical, sum(n) OVER (PARTITION BY side, look)::BIGINT AS n_rows, count(*) OVER (PARTITION BY side, look) AS members FROM c)"""

_FORM = f"regexp_replace(replace(replace({_look_sql().replace('(value,', '(lower(value),')}, 'ς', 'σ'), 'ß', 'ss'), '[\\p{{P}}\\p{{S}}\\p{{C}}]', '', 'g')"
#: Runs of ten words, and of 24 characters where words are not spaced, of every item and text; a text leaks what it shares.
_LEAKS = rf"""it AS (SELECT item_id, lang IN ('cmn_Hani', 'jpn_Jpan') AS unspaced, {_FORM} AS form FROM (SELECT item_id, lang, text AS value FROM eval_items)),
    tx AS (SELECT pair_id, side, {_FORM} AS form FROM (SELECT pair_id, 'anchor' AS side, anchor AS value FROM pairs UNION ALL SELECT pair_id, 'positive', positive FROM pairs) WHERE value <> ''),
    iw AS (SELECT item_id, regexp_extract_all(form, '[^\s\p{{Z}}]+') AS w FROM it WHERE NOT unspaced), ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM iw)),
    xw AS (SELECT pair_id, side, regexp_extract_all(form, '[^\s\p{{Z}}]+') AS w FROM tx), xg AS (SELECT pair_id, side, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT pair_id, side, w, unnest(range(1, len(w) - 8)) AS i FROM xw)),
    ic AS (SELECT item_id, regexp_replace(form, '[\s\p{{Z}}]+', '', 'g') AS c FROM it WHERE unspaced), jg AS (SELECT DISTINCT item_id, substr(c, i, 24) AS g FROM (SELECT item_id, c, unnest(range(1, length(c) - 22)) AS i FROM ic)),
    xc AS (SELECT pair_id, side, regexp_replace(form, '[\s\p{{Z}}]+', '', 'g') AS c FROM tx WHERE regexp_matches(form, '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]')), yg AS (SELECT pair_id, side, substr(c, i, 24) AS g FROM (SELECT pair_id, side, c, unnest(range(1, length(c) - 22)) AS i FROM xc)),
    lk AS (SELECT DISTINCT pair_id, side, item_id FROM xg JOIN ig USING (g) UNION SELECT DISTINCT pair_id, side, item_id FROM yg JOIN jg USING (g))"""

#: Characters of the longest piece of the vocabulary, which is a table of fixed size.
_LONGEST = 24


def _tokens_sql() -> str:
    """(id, n): tokens of ``src`` (id, text): at each character the longest piece that begins there, then from left to right."""
    after = ", ".join(f"lead(ch, {k}) OVER w AS c{k}" for k in range(1, _LONGEST))
    pieces = ", ".join(f"CASE WHEN ch{''.join(f' || c{i}' for i in range(1, k))} IN (SELECT piece FROM vc) THEN {k} ELSE 0 END" for k in range(1, _LONGEST + 1))
    return rf"""vc AS (SELECT DISTINCT piece FROM vocab WHERE NOT is_marker AND piece <> ''), ch AS (SELECT id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS pos FROM src WHERE text <> ''),
    ld AS (SELECT id, pos, ch, {after} FROM ch WINDOW w AS (PARTITION BY id ORDER BY pos)), bs AS (SELECT id, pos, ch, greatest({pieces}) AS len FROM ld),
    ls AS (SELECT id, list({{'skip': CASE WHEN len = 0 THEN 1 ELSE len END, 'n': CASE WHEN len = 0 AND regexp_matches(ch, '^[\s\p{{Z}}\x0B\x1C-\x1F\x85]$') THEN 0 ELSE 1 END}} ORDER BY pos) AS l FROM bs GROUP BY id),
    ct AS (SELECT id, list_reduce(list_prepend({{'skip': 0, 'n': 0}}, l), lambda a, x: CASE WHEN a.skip > 0 THEN {{'skip': a.skip - 1, 'n': a.n}} ELSE {{'skip': x.skip - 1, 'n': a.n + x.n}} END).n::BIGINT AS n FROM ls),
    counted AS (SELECT src.id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(n, 0) END AS n FROM src LEFT JOIN ct USING (id))"""


def _cube_sql(corpus: str, columns: tuple[str, ...], rows: str) -> str:
    """The cube of ``rows`` (columns, label, n, first), labels read as in ``token_budget.with_language``."""
    none = ", ".join(f"'{x}'" for x in sorted(langid.NO_LANGUAGE))
    und = ", ".join(f"CASE WHEN coalesce({c}, '') = '' THEN 'und' ELSE {c} END AS {c}" for c in columns)
    parts = ", ".join(f"CASE WHEN grouping({c}) = 0 THEN '{c}' END" for c in columns)
    missing = "" if "web_domain" in columns else "NULL::VARCHAR AS web_domain, "
    return f"""SELECT '{corpus}' AS corpus, {', '.join(columns)}, {missing}coalesce(nullif(concat_ws('+', {parts}), ''), 'all') AS slice, count(*) AS n_texts, sum(n)::BIGINT AS n_tokens, count(first) AS n_first_texts, coalesce(sum(first), 0)::BIGINT AS n_first_tokens
    FROM (SELECT {und}, n, first FROM (SELECT x.* EXCLUDE (lang), coalesce(a.code, CASE WHEN plain NOT IN ({none}) AND head NOT IN ({none}) THEN coalesce(b.code, x.lang) END) AS lang
        FROM (SELECT *, replace(lower(trim(lang)), '-', '_') AS plain, split_part(replace(lower(trim(lang)), '-', '_'), '_', 1) AS head FROM ({rows})) x LEFT JOIN sp a ON a.s = plain LEFT JOIN sp b ON b.s = head) WHERE n IS NOT NULL) GROUP BY CUBE ({', '.join(columns)})"""


_SPELLED = "sp AS (SELECT replace(lower(trim(s)), '-', '_') AS s, min(lang_code) AS code FROM (SELECT lang_code, unnest([lang_code, split_part(lang_code, '_', 1), iso639_1, english_name]) AS s FROM languages WHERE lang_code IS NOT NULL) WHERE s <> '' GROUP BY 1)"
_LABEL = "CASE WHEN coalesce(anchor_language_id, '') = '' THEN language_id ELSE anchor_language_id END"
_TOTALS = f"""
    WITH src AS (SELECT doc_id * 2 AS id, text FROM documents UNION ALL SELECT pair_id * 2 + 1, anchor FROM pairs), {_tokens_sql()}, {_SPELLED},
    fd AS (SELECT min(pair_id) AS pair_id FROM pairs WHERE shard_id IS NOT NULL AND row_group IS NOT NULL AND row_index IS NOT NULL GROUP BY shard_id, row_group, row_index)
    {_cube_sql('documents', ('source', 'lang', 'web_domain'), 'SELECT source, lang, web_domain, n, n AS first FROM documents JOIN counted ON id = doc_id * 2')}
    UNION ALL BY NAME
    {_cube_sql('pairs', ('source', 'lang'), f"SELECT source, {_LABEL} AS lang, n, CASE WHEN fd.pair_id IS NOT NULL OR shard_id IS NULL OR row_group IS NULL OR row_index IS NULL THEN n END AS first FROM pairs p JOIN counted ON id = p.pair_id * 2 + 1 LEFT JOIN fd ON fd.pair_id = p.pair_id")}"""

def _prefix_sql(texts: str) -> str:
    """Every text with an open end against every longer one."""
    return (
        r"""
        WITH k AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[\s\[(（]*(\.{2,}|…+|。{2,}|[\[(（](\.{2,}|…)[\])）])\s*$', ''), '\s+$', '') AS cut FROM (TEXTS)),
        c AS (SELECT doc_id, cut FROM k WHERE regexp_matches(cut, '\p{L}') AND NOT regexp_matches(cut, '[.!?。！？؟।॥;；…]+["''»”’)\]）」』】》]*$')),
        l AS (SELECT c.doc_id, k.doc_id AS longer, right(c.cut, 1) AS last, substr(k.cut, length(c.cut) + 1, 64) AS after FROM c JOIN k ON starts_with(k.cut, c.cut) AND length(k.cut) > length(c.cut)),
        w AS (SELECT *, regexp_matches(last, '[\p{L}\p{M}\p{N}]') AND regexp_matches(after, '^[''’\-‐‑]?[\p{L}\p{M}\p{N}]') AS word FROM l),
        s AS (SELECT *, NOT word AND (regexp_matches(last, '[,،、，''’\-‐‑(（\[]') OR regexp_matches(after, '^([^\S\r\n]*[,،、，]?[^\S\r\n]+[\p{L}\p{M}]|[,،、，]$)')) AS sentence FROM w)
        SELECT doc_id, count(*) FILTER (word) AS n_word, count(*) FILTER (sentence) AS n_sentence, count(*) FILTER (NOT word AND NOT sentence) AS n_end,
        coalesce(min(longer) FILTER (word OR sentence), min(longer)) AS longer_doc_id FROM s GROUP BY doc_id"""
    ).replace("TEXTS", texts)


ORACLES: dict[str, str] = {
    "p3_document_tokens": f"WITH src AS (SELECT doc_id AS id, text FROM documents), {_tokens_sql()} SELECT id AS doc_id, n AS n_tokens FROM counted",
    "p3_token_totals": _TOTALS,
    "p2_found": f"WITH {_LEAKS} SELECT * FROM lk",
    "p2_leaks_by_source": f"WITH {_LEAKS} SELECT source, count(DISTINCT pair_id) AS n_rows, count(*) AS n_leaks, count(DISTINCT item_id) AS n_items FROM lk JOIN pairs USING (pair_id) GROUP BY 1",
    "p4_found": f"WITH {_LOOKS} SELECT a.pair_id AS pair_id_1, b.pair_id AS pair_id_2, a.side FROM l a JOIN l b ON a.side = b.side AND a.look = b.look AND a.value <> b.value AND a.pair_id < b.pair_id",
    "p4_canonical": f"WITH {_LOOKS} SELECT l.pair_id, l.side, l.value, coalesce(k.canonical, l.value) AS canonical FROM l LEFT JOIN k ON k.side = l.side AND k.look = l.look AND k.value = l.value",
    "p4_classes": f"WITH {_LOOKS} SELECT pair_id, l.side, canonical, n_rows, n_rows - n AS n_links FROM l JOIN k ON k.side = l.side AND k.look = l.look AND k.value = l.value WHERE members > 1",
    "p1_found": f"SELECT pair_key FROM ({_TOP})",
    "p1_top_support": f"SELECT pair_key, support, row_number() OVER (ORDER BY support DESC, pair_key) AS rank FROM ({_TOP})",
    "p8_prefix_copies": _prefix_sql("SELECT doc_id, text FROM documents"),
    "p8_anchor_prefixes": _prefix_sql("SELECT pair_id AS doc_id, anchor AS text FROM pairs"),

}
