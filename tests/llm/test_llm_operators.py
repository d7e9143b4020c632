from __future__ import annotations

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.llm import heavy_hitters, langid, leaks, lookalikes, mixing, packing, scripts, sizes, token_budget, truncation


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# 1 ---------------------------------------------------------------------------------------------------------------------


def records(spark, data):
    return spark.createDataFrame(data, "record_id long, pair_key long, support long").withColumns({"weight": F.lit("x"), "item": F.lit(0), "lower": F.lit(1)})


def test_summary_keeps_its_bounds(spark):
    rng = random.Random(1)
    data = [(i, min(int(rng.paretovariate(0.6)), 5000), rng.randint(1, 9)) for i in range(6000)]
    exact: dict[int, int] = {}
    for _, k, w in data:
        exact[k] = exact.get(k, 0) + w
    for capacity in (20, 200):
        out = heavy_hitters.misra_gries(records(spark, data).repartition(7), "pair_key", "support", capacity).collect()
        assert len(out) <= capacity
        got = {r["item"]: (r["lower"], r["upper"]) for r in out}
        error = max(u - low for low, u in got.values())
        assert error <= sum(exact.values()) / (capacity + 1) and all(low <= exact[k] <= u for k, (low, u) in got.items())
        assert all(k in got for k, w in exact.items() if w > error)


def test_top_items(spark):
    data = [(1, 10, 5), (1, 10, 5), (2, 20, 5), (3, 30, 1), (4, None, 9), (5, 40, None), (6, 50, 0), (None, 60, 2), (None, 60, 2), (7, 70, 3), (7, 70, 2), (7, 80, 1)]
    out = heavy_hitters.top_items(records(spark, data), "pair_key", "support", "record_id", 5)
    assert rows(out, "item", "weight") == [(10, 5), (20, 5), (30, 1), (60, 4), (70, 2)]
    assert heavy_hitters.top_items(records(spark, data).where("false"), "pair_key", "support", "record_id", 3).count() == 0
    assert heavy_hitters.top_items(records(spark, [(1, 5, 0)]), "pair_key", "support", "record_id", 3).count() == 0


def test_flat_keys_never_pass_the_ceiling(spark, monkeypatch):
    """All items alike: no summary can prove an order, so beyond the ceiling items are counted by a group-by."""
    tried = []
    made = heavy_hitters.misra_gries
    monkeypatch.setattr(heavy_hitters, "misra_gries", lambda df, item, weight, capacity: tried.append(capacity) or made(df, item, weight, capacity))
    flat = records(spark, [(i, i, 1) for i in range(300)])
    out = heavy_hitters.top_items(flat, "pair_key", "support", "record_id", 4, capacity=16, most=64)
    assert rows(out, "item", "weight", "lower", "upper") == [(i, 1, 1, 1) for i in range(4)]
    assert tried == [16, 64]
    tried.clear()
    assert rows(heavy_hitters.top_items(flat, "pair_key", "support", "record_id", 4, capacity=16, most=1024), "item") == [(0,), (1,), (2,), (3,)]
    assert tried == [16, 64, 256, 1024]


# 2 ---------------------------------------------------------------------------------------------------------------------

ITEM = "The village baker Vegasa described the torn letter Monafa beside the river mill Notori shortly before noon."


def corpus(spark, texts):
    return spark.createDataFrame([(i, a, p) for i, (a, p) in enumerate(texts)], "pair_id long, anchor string, positive string").withColumn("item_id", F.lit(-1)).withColumn("text", F.lit("x"))


def test_leaks(spark):
    items = spark.createDataFrame([(1, "eng_Latn", ITEM), (2, "eng_Latn", ITEM), (3, "cmn_Hani", "村里的面包师在上个星期二快到中午的时候描述了撕破的信和河边磨坊旁的银勺子。"), (4, "eng_Latn", None), (5, "eng_Latn", ""), (6, "eng_Latn", "too short")], "item_id long, lang string, text string")
    words = ITEM.split()
    texts = [
        (ITEM.upper(), None), ("", "intro. " + " ".join(words[2:12]) + "\nmore"), (" ".join(words[2:11]), " ".join(words[3:9])), (ITEM.replace("bak", "bа­k").replace(" ", "  ", 3), "x"),
        ("前言，村里的面包师在上个星期二，快到中午的时候 描述了撕破的信", "村里的面包师在上个星期二快到"), ("word " * 40000 + ITEM, "too short"), (None, None),
    ]
    got = rows(leaks.leaked(corpus(spark, texts), items))
    assert got == sorted([(p, s, i) for p, s in ((0, "anchor"), (1, "positive"), (3, "anchor"), (5, "anchor")) for i in (1, 2)] + [(4, "anchor", 3)], key=repr)
    assert leaks.leaked(corpus(spark, texts).where("false"), items).count() == 0
    assert leaks.leaked(corpus(spark, texts), items.where("false")).count() == 0
    per_source = leaks.leaks_by_source(leaks.leaked(corpus(spark, texts), items), corpus(spark, texts).withColumn("source", F.lit(None).cast("string")))
    assert rows(per_source) == [(None, 5, 9, 3)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_positional_search_against_brute_force(seed):
    rng = random.Random(seed)
    vocab = "abcde"[: rng.randint(2, 5)]
    items = [(i, [rng.choice(vocab) for _ in range(rng.randint(0, 14))]) for i in range(4)]
    texts = [[rng.choice(vocab + "z") for _ in range(rng.randint(0, 40))] for _ in range(6)]
    run = rng.randint(2, 5)
    queries = leaks.Queries(items, run)
    t, q = leaks.Postings.of(texts, queries.vocab).search(queries)
    got = {(int(a), int(queries.owner[b])) for a, b in zip(t, q)}
    grams = lambda x: {tuple(x[i : i + run]) for i in range(len(x) - run + 1)}
    assert got == {(a, i) for a, text in enumerate(texts) for i, item in items if grams(text) & grams(item)}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_proximity_against_brute_force(seed):
    """Every window laid upon every place: words met within the slack, and no place of another text."""
    rng = random.Random(seed)
    vocab, run, missing, slack = "abcdefgh"[: rng.randint(3, 8)], rng.randint(3, 5), rng.randint(0, 2), rng.randint(0, 2)
    items = [(i, [rng.choice(vocab) for _ in range(rng.randint(0, 9))]) for i in range(3)]
    texts = [[rng.choice(vocab + "z") for _ in range(rng.randint(0, 12))] for _ in range(4)]
    queries = leaks.Queries(items, run)
    t, q, met = leaks.Postings.of(texts, queries.vocab).near(queries, missing, slack)
    got: dict = {}
    for a, b, n in zip(t, q, met):
        got[int(a), int(queries.owner[b])] = max(int(n), got.get((int(a), int(queries.owner[b])), 0))
    want: dict = {}
    for a, text in enumerate(texts):
        for i, item in items:
            for w in range(len(item) - run + 1):
                for begin in range(-run - slack, len(text) + slack):
                    n = sum(any(0 <= begin + k + d < len(text) and text[begin + k + d] == item[w + k] for d in range(-slack, slack + 1)) for k in range(run))
                    if n >= run - missing and n:
                        want[a, i] = max(n, want.get((a, i), 0))
    assert got == want


def test_near_and_stored_index(spark, monkeypatch):
    items = spark.createDataFrame([(1, "eng_Latn", ITEM), (2, "cmn_Hani", "村里的面包师在上个星期二快到中午的时候描述了撕破的信和河边磨坊旁的银勺子。"), (None, "eng_Latn", ITEM)], "item_id long, lang string, text string")
    words = ITEM.split()
    swapped, changed, far = words[2:12], words[2:12], words[2:12]
    swapped[3], swapped[4] = swapped[4], swapped[3]
    changed[2], changed[5] = "x", "y"
    far[1:1] = ["p", "q", "r", "s", "t"]
    df = corpus(spark, [(" ".join(swapped), " ".join(changed)), (" ".join(far), ITEM), ("x " * 50, "。！"), (None, "")])
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 1)  # many blocks
    stored = leaks.index(df.repartition(1), segment_terms=15)  # many segments
    assert stored.count() == 3
    assert rows(leaks.search(stored, items)) == [(1, "positive", 1)]
    assert rows(leaks.near(stored, items)) == [(0, "anchor", 1, 10, 10), (0, "positive", 1, 8, 10), (1, "anchor", 1, 9, 10), (1, "positive", 1, 10, 10)]
    assert leaks.near(stored, items.where("false")).count() == 0 and leaks.near(stored.where("false"), items).count() == 0


def test_found_leaks_against_brute_force(spark):
    """All pairs against all items, by sets of runs of words and of characters."""
    from oracle import DATA

    pairs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("pairs", "eval_items"))
    grams = lambda x, n: {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
    of: dict = {}
    for r in items.collect():
        unspaced = r["lang"] in leaks.UNSPACED_LANGUAGES
        for g in grams(list(leaks.characters(r["text"])), leaks.CHARS) if unspaced else grams(leaks.words(r["text"]), leaks.WORDS):
            of.setdefault(g, set()).add(r["item_id"])
    want = set()
    for r in pairs.collect():
        for side in ("anchor", "positive"):
            text = r[side] or ""
            for g in grams(leaks.words(text), leaks.WORDS) | grams(list(leaks.characters(text)), leaks.CHARS):
                want |= {(r["pair_id"], side, i) for i in of.get(g, ())}
    assert set(rows(leaks.leaked(pairs, items))) == want


def test_search_in_slices(monkeypatch):
    queries = leaks.Queries([(7, list("abab" * 4))], 4)
    texts = [list("ab" * 30), list("ba" * 3), list("zz")]
    want = {0, 1}
    monkeypatch.setattr(leaks, "CANDIDATES", 5)
    t, _ = leaks.Postings.of(texts, queries.vocab).search(queries)
    assert set(t.tolist()) == want


# 3 ---------------------------------------------------------------------------------------------------------------------

PIECES = ["a", "b", "ab", "abc", "bcd", "c", " ", "d", "ééé", "é"]


def greedy(text, pieces, longest=4):
    n = i = 0
    while i < len(text):
        for k in range(longest, 0, -1):
            if text[i : i + k] in pieces and i + k <= len(text):
                n, i = n + 1, i + k
                break
        else:
            n, i = n + (not text[i].isspace()), i + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdé x\n ", max_size=40))
def test_token_counts_are_greedy(text):
    assert token_budget.PieceTokenizer(PIECES).count(text) == greedy(text, set(PIECES))
    assert token_budget.PieceTokenizer([*PIECES, "a\nb"]).count(text) == greedy(text, {*PIECES, "a\nb"})
    assert token_budget.PieceTokenizer([]).count(text) == sum(not c.isspace() for c in text)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text(alphabet="abc \n", min_size=1, max_size=5), max_size=8), st.text(alphabet="abcx \n", max_size=30))
def test_token_counts_are_greedy_for_any_pieces(pieces, text):
    """Also where a long piece fails late and no shorter one began where it did."""
    assert token_budget.PieceTokenizer(sorted(pieces)).count(text) == greedy(text, pieces, 5)
    assert token_budget.PieceTokenizer(["b", "caaac", "aa"]).count("abaacbaacbbbaabaacaa") == greedy("abaacbaacbbbaabaacaa", {"b", "caaac", "aa"}, 5)


def test_token_cube(spark):
    vocab = spark.createDataFrame([(i, p, False) for i, p in enumerate(PIECES)] + [(99, "__eng_Latn__", True), (100, None, False)], "token_id int, piece string, is_marker boolean")
    docs = spark.createDataFrame([("s", "x", "abc ab"), ("s", None, ""), (None, "", "d" * 50_000), ("s", "x", None)], "source string, lang string, text string").withColumn("piece", F.lit(1)).withColumn("slice", F.lit(1))
    counted = token_budget.count_tokens(docs, "text", vocab)
    assert sorted(r["n_tokens"] for r in counted.where("n_tokens is not null").collect()) == [0, 3, 50_000] and counted.where("n_tokens is null").count() == 1
    cube = {(r["source"], r["lang"], r["slice"]): (r["n_texts"], r["n_tokens"]) for r in token_budget.token_cube(counted, "source", "lang").collect()}
    assert cube[None, None, "all"] == (3, 50_003) and cube["s", None, "source"] == (2, 3) and cube["und", "und", "source+lang"] == (1, 50_000) and cube[None, "und", "lang"] == (2, 50_000)
    assert token_budget.token_cube(token_budget.count_tokens(docs.where("false"), "text", vocab), "source").count() == 0


def test_labels_and_repeated_deliveries(spark):
    known = spark.createDataFrame([("eng_Latn", "en", "English"), ("cmn_Hani", "zh", "Chinese"), (None, None, None)], "lang_code string, iso639_1 string, english_name string")
    data = [(1, "EN", 3, 1), (2, "eng-Latn", 3, 2), (3, " English ", 3, 3), (4, "eng_Cyrl", 3, 4), (5, "xyz_Latn", 3, 5), (6, None, 3, 6), (7, "", 3, 7), (8, "N/A", 3, 8), (9, "eng_Latn", 4, 1), (10, "eng_Latn", None, 1), (11, "zh", 2, None)]
    df = spark.createDataFrame(data, "pair_id long, lang string, n_tokens long, row_index long").withColumns({"code": F.lit("q"), "head": F.lit("q")})
    coded = token_budget.with_language(df, "lang", known)
    assert [r["lang"] for r in coded.orderBy("pair_id").collect()] == ["eng_Latn"] * 4 + ["xyz_Latn", None, None, None, "eng_Latn", "eng_Latn", "cmn_Hani"]
    once = token_budget.first_tokens(coded, ["row_index"], "pair_id", "n_tokens")
    assert {r["pair_id"]: r["n_first"] for r in once.collect()} == {1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 8: 3, 9: None, 10: None, 11: 2}


# 4 ---------------------------------------------------------------------------------------------------------------------


def test_equal_looking(spark):
    values = ["Café noir", "Café noir", "Cаfé noir", "Ｃafé noir", "CAFÉ noir", "Cafe noir", "Café noir!", "Café no​ir", "", None, "ガラス", "ｶﾞﾗｽ", "ﬁn", "fin", "plain", "plain"]
    df = spark.createDataFrame([(i, "anchor", v) for i, v in enumerate(values)], "pair_id long, side string, value string").withColumns({"look": F.lit(1), "c": F.lit(2), "canonical": F.lit(3)})
    got = rows(lookalikes.equal_looking(df), "pair_id_1", "pair_id_2")
    same = [0, 1, 2, 3, 7]
    assert got == sorted([(a, b) for i, a in enumerate(same) for b in same[i + 1 :]] + [(10, 11), (12, 13)], key=repr)
    forms = {r["pair_id"]: r["canonical"] for r in lookalikes.canonical_forms(df).collect()}
    assert len(forms) == len(values) and len({forms[i] for i in same}) == 1 and forms[4] == "CAFÉ noir" and forms[8] == "" and forms[9] is None
    assert lookalikes.equal_looking(df.where("false")).count() == 0 and lookalikes.canonical_forms(df.where("false")).count() == 0


def test_copies_of_a_value_are_one(spark):
    df = spark.createDataFrame([(i, "positive", "same") for i in range(500)] + [(1000, "positive", "sаme"), (1000, "positive", "ｓame")], "pair_id long, side string, value string")
    out = lookalikes.equal_looking(df)
    assert out.count() == 1000 and out.where("pair_id_1 = pair_id_2").count() == 0
    assert rows(lookalikes.classes(lookalikes.shared_looks(df)), "value", "canonical", "n_rows") == [("same", "same", 500), ("sаme", "same", 1), ("ｓame", "same", 1)]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="eéaо́oе́​ｅ  가각", max_size=12))
def test_coarse_looks_ignore_composition(spark, text):
    table = lookalikes.look_table(spark)
    look = lambda t: lookalikes.coarse_of(lookalikes.look_of(t, table))
    composed, apart = unicodedata.normalize("NFC", text), unicodedata.normalize("NFD", text)
    assert look(composed) == look(apart)
    assert unicodedata.normalize("NFC", lookalikes.look_of(composed, table)) == unicodedata.normalize("NFC", lookalikes.look_of(apart, table))


def test_looks_of_letters_ignore_composition(spark):
    """Every letter that has a decomposition, composed and not, has one look."""
    table = lookalikes.look_table(spark)
    look = lambda t: unicodedata.normalize("NFC", lookalikes.look_of(t, table))
    letters = [c for c in map(chr, (*range(0xC0, 0x250), *range(0x370, 0x590), *range(0x1E00, 0x2000))) if unicodedata.normalize("NFD", c) != c]
    wrong = [c for c in letters if look(c) != look(unicodedata.normalize("NFD", c))]
    assert len(letters) > 800 and not wrong


def test_look_alikes(spark):
    table = lookalikes.look_table(spark)
    look = lambda t: unicodedata.normalize("NFC", lookalikes.look_of(t, table))
    alike = ["а a", "ο o", "օ o", "ｎ n", "𝐚 a", "𝕏 X", "ℓ l", "ⅳ iv", "Ⅳ IV", "ᴏ o", "ﬁ fi", "𝟎 0", "𝟏 1", "І I", "Ι I", "ϲ c", "ѐ è", "ύ ú", "ί í", "ɡ g", "Ԛ Q", "⼤ 大", "ⅿ m", "𝐦 m", "ｶﾞ ガ", "а\u200bb ab", "ι\u0301 í", "ι\u0301 ί", "ι\u200b\u0301 ί"]
    for pair in alike:
        a, b = pair.split(" ")
        assert look(a) == look(b), pair
    apart = ["ı i", "ı l", "ι i", "’ '", "‘ '", "− -", "‐ -", "– -", "I l", "l 1", "O 0", "o O", "rn m", "é e", "š ŝ", "ă ǎ", "ø o", "ł l", "① 1", "² 2", "а А", "! ¡", ". ,"]
    for pair in apart:
        a, b = pair.split(" ")
        assert look(a) != look(b), pair
    assert all(look(a) == look(b) for a, b in scripts.LOOK_ALIKES.items() if a not in "ιı")
    df = spark.createDataFrame([(i, "anchor", v) for i, v in enumerate(["kır", "kir", "it's", "it’s", "a-b", "a−b", "ready", "rеady", "ready"])], "pair_id long, side string, value string")
    assert rows(lookalikes.equal_looking(df), "pair_id_1", "pair_id_2") == [(6, 7), (7, 8)]
    assert rows(lookalikes.look_classes(df)) == [(6, "anchor", "ready", 3, 1), (7, "anchor", "ready", 3, 2), (8, "anchor", "ready", 3, 1)]
    assert lookalikes.look_classes(df.where("false")).count() == 0


def test_words_take_one_script():
    assert scripts.unify("Lе vоіѕіn dіѕсrеt") == "Le voisin discret"
    assert scripts.unify("вечеpом зa") == "вечером за" and scripts.unify("plain") == "plain" and scripts.unify("Ｎo​w") == "Now"


# 5 ---------------------------------------------------------------------------------------------------------------------

SAMPLES = {
    "eng_Latn": ["The old librarian sold the wooden bridge behind the railway station.", "Nobody had expected such a result before the long meeting."],
    "deu_Latn": ["Der alte Bibliothekar verkaufte die Brücke hinter dem Bahnhof.", "Niemand hatte vor der langen Sitzung ein solches Ergebnis erwartet."],
    "rus_Cyrl": ["Старый библиотекарь продал деревянный мост за вокзалом.", "Никто не ожидал такого результата до собрания."],
    "cmn_Hani": ["年老的图书管理员在火车站后面卖掉了木桥。", "没有人料到会有这样的结果。"],
}


@pytest.fixture(scope="module")
def profiles():
    return langid.train([(lang, t) for lang, ts in SAMPLES.items() for t in ts])


def test_bundles_are_what_the_shortcut_says(profiles):
    """The sum of the n-grams' scores is the dot product of the bundled vectors."""
    text = langid.letters("die lange Brücke")
    codes, _ = langid._grams([text])
    bundle = langid._gram_vectors(codes).astype("float64").sum(axis=0)
    want = bundle @ profiles.prototypes.T.astype("float64") / np.sqrt(len(codes) * langid.DIMENSIONS)
    assert np.allclose(profiles.cosines([text])[0], want, atol=1e-4)
    assert (profiles.cosines(["  "]) == 0).all()
    kept = profiles.cosines([text])
    profiles.codes, profiles.scores = profiles.codes[:0], profiles.scores[:0]
    assert np.allclose(kept, profiles.cosines([text]), atol=1e-5)


def test_wrong_labels(spark, profiles):
    texts = [
        (1, "The librarian had expected the long meeting.", "EN"), (2, "The librarian had expected the long meeting.", "deu_Latn"), (3, "Der Bibliothekar hatte die Sitzung erwartet.", None), (4, "", "und"), (5, None, "eng_Latn"),
        (6, "The librarian had expected the meeting. Niemand hatte ein solches Ergebnis erwartet.", "eng-Latn"), (7, "Kobako", "und"), (8, "没有人料到这样的结果。", "xxx_Zyyy"), (9, "The meeting at the old station was long. Бобров", "eng"), (10, "Der alte Bibliothekar " * 2000, "German"),
    ]
    df = spark.createDataFrame(texts, "pair_id long, anchor string, language_id string").withColumns({"lang": F.lit("q"), "label": F.lit("q"), "text": F.lit("q")})
    known = spark.createDataFrame([("eng_Latn", "en", "English"), ("deu_Latn", "de", "German"), ("rus_Cyrl", "ru", "Russian"), ("cmn_Hani", "zh", "Chinese"), (None, None, None)], "lang_code string, iso639_1 string, english_name string")
    judged = langid.text_languages(df, profiles, known, "pair_id", "anchor", F.col("language_id"))
    assert rows(langid.wrong_labels(judged)) == [(2, "eng_Latn"), (3, "deu_Latn"), (6, "deu_Latn"), (6, "eng_Latn"), (8, "cmn_Hani")]
    parts = langid.segment_languages(df, profiles).where("pair_id = 6").orderBy("part").collect()
    assert [p["lang"] for p in parts] == ["eng_Latn", "deu_Latn"] and all(0 < p["confidence"] <= 1 for p in parts)
    assert langid.text_languages(df.where("false"), profiles, known, "pair_id", "anchor", F.col("language_id")).count() == 0


def test_confidence_on_held_out_samples(spark):
    """Fitted on two thirds of the labelled samples: nearly all others are right, and the surer the more so."""
    from oracle import DATA

    samples = sorted((r["sample_id"], r["lang"], r["text"]) for r in spark.read.parquet(f"{DATA}/lang_samples.parquet").collect())
    model = langid.train([(lang, t) for i, lang, t in samples if i % 3])
    held = [(lang, t) for i, lang, t in samples if i % 3 == 0]
    best, sure = model.judge([t for _, t in held])
    right = np.array([model.languages[b] == lang for b, (lang, _) in zip(best, held)])
    assert right.mean() > 0.97 and ((sure > 0) & (sure <= 1)).all()
    assert right[sure > 0.9].mean() > 0.99 and right[sure > 0.9].mean() >= right[sure <= 0.9].mean()


def test_segments_of_joined_samples(spark):
    """Two held-out samples of different languages, a sentence each, come out as segments of these languages."""
    from oracle import DATA

    samples = sorted((r["sample_id"], r["lang"], r["text"]) for r in spark.read.parquet(f"{DATA}/lang_samples.parquet").collect())
    model = langid.train([(lang, t) for i, lang, t in samples if i % 3])
    held = [(lang, langid.sentences(t)[0]) for i, lang, t in samples if i % 3 == 0]
    held = [(lang, t) for lang, t in held if len(t) > 40]
    joined = [(k, a[0], b[0], f"{a[1]}\n{b[1]}") for k, (a, b) in enumerate(zip(held, held[7:])) if a[0] != b[0]]
    df = spark.createDataFrame([(k, t) for k, _, _, t in joined], "pair_id long, anchor string")
    got: dict = {}
    for r in langid.segment_languages(df, model).orderBy("pair_id", "part").collect():
        got.setdefault(r["pair_id"], []).append(r["lang"])
    assert np.mean([got[k][0] == a and got[k][-1] == b for k, a, b, _ in joined]) > 0.95


def test_fit_is_bounded_and_checked(spark):
    samples = spark.createDataFrame([(lang, t) for lang, ts in SAMPLES.items() for t in ts] + [(None, "x"), ("eng_Latn", None)], "lang string, text string")
    more = spark.createDataFrame([(i, "eng_Latn" if i % 2 else "xyz_Latn", "some words") for i in range(50)] + [(99, None, None)], "doc_id long, lang string, text string")
    assert langid.fit(samples, more, 5).languages == sorted(SAMPLES)
    with pytest.raises(ValueError):
        langid.train([])


# 6 ---------------------------------------------------------------------------------------------------------------------


def sized(spark, sizes_, terms=lambda i: [i % 7, 100 + i % 3]):
    return spark.createDataFrame([(i, n, terms(i), [1] * len(terms(i))) for i, n in enumerate(sizes_)], "doc_id long, n_tokens long, terms array<int>, terms_tf array<int>").withColumn("limit_id", F.lit(0))


def test_packing(spark):
    rng = random.Random(2)
    sizes_ = [rng.choice([rng.randint(1, 60), rng.randint(60, 400)]) for _ in range(400)] + [0, 100, 100]
    limits = spark.createDataFrame([(1, 100), (2, 256), (3, None), (4, 0)], "limit_id int, capacity_tokens int")
    out = packing.pack(sized(spark, sizes_), limits, shard_rows=100).toPandas()
    assert set(out.limit_id) == {1, 2}
    for limit, capacity in ((1, 100), (2, 256)):
        mine = out[out.limit_id == limit]
        assert mine.groupby("container_id").n_tokens.sum().max() <= capacity
        for doc, parts in mine.groupby("doc_id"):
            spans = sorted((int(f), int(n)) for f, n in zip(parts.first_token, parts.n_tokens))
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) == sizes_[doc]
            assert len(spans) == 1 or sizes_[doc] > capacity
        assert set(mine.doc_id) == {i for i, n in enumerate(sizes_) if n}
    rates = {r["limit_id"]: r["fill_rate"] for r in packing.fill_rates(packing.pack(sized(spark, sizes_), limits, shard_rows=200)).collect()}
    assert min(rates.values()) > 0.95
    assert packing.pack(sized(spark, sizes_).where("false"), limits).count() == 0 and packing.pack(sized(spark, sizes_), limits.where("false")).count() == 0


def test_neighbours_come_first():
    terms = [np.array([1, 2, 3]), np.array([1, 2, 3]), np.array([7, 8]), np.array([1, 9])]
    index = packing.Index(terms, [np.ones(len(t)) for t in terms], np.array([6, 4, 4, 4]))
    assert index.scores(0)[1] > index.scores(0)[3] > index.scores(0)[2] == 0
    assert index.neighbours(0).tolist() == [1, 0, 3] and index.neighbours(0) is index.neighbours(0)
    assert packing.fill(index, np.array([6, 4, 4, 4]), 10)[0] == [(0, 0, 6), (1, 0, 4)]


def test_scores_against_brute_force():
    rng = np.random.default_rng(5)
    terms = [np.unique(rng.integers(0, 20, 8)) for _ in range(12)]
    tf = [rng.integers(1, 4, len(t)) for t in terms]
    sizes_ = np.array([int(x.sum()) for x in tf])
    index = packing.Index(terms, tf, sizes_)
    for q in range(12):
        want = np.zeros(12)
        for t in terms[q]:
            df = sum(t in x for x in terms)
            idf = np.log(1 + (12 - df + 0.5) / (df + 0.5))
            for d in range(12):
                if t in terms[d]:
                    f = tf[d][list(terms[d]).index(t)]
                    want[d] += idf * f * (packing.K1 + 1) / (f + packing.K1 * (1 - packing.B + packing.B * sizes_[d] / sizes_.mean()))
        assert np.allclose(index.scores(q), want, rtol=1e-4)


def test_sizes_of_texts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "a b " * 20_000)], "doc_id long, text string").withColumn("terms", F.lit(1))
    out = {r["doc_id"]: r["n_tokens"] for r in sizes.with_sizes(df.select("doc_id", "text"), "text", terms="terms").collect()}
    model = sizes.piece_model(sizes.TOKENIZER)
    assert out == {1: len(model.encode("hello world")), 2: 0, 3: 0, 4: len(model.encode("a b " * 20_000))}


# 7 ---------------------------------------------------------------------------------------------------------------------


def mixture_inputs(spark):
    docs = [(i, "a", 10) for i in range(300)] + [(1000 + i, "b", 5) for i in range(20)] + [(5000, "none", 9), (5001, None, 9), (5002, "a", 0), (5003, "b", None)]
    sized_ = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").withColumns({"pass": F.lit(1), "block": F.lit(2), "share": F.lit(3)})
    return sized_, spark.createDataFrame([("a", 0.8, 1), ("b", 0.2, 3), ("gone", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")


def test_mixture(spark):
    docs, targets = mixture_inputs(spark)
    out = mixing.mix(docs, targets).orderBy("position").toPandas()
    by = out.groupby("source").n_tokens.sum()
    assert by["b"] == 300 and abs(by["a"] - 1200) <= 10  # b gives all it may, a what fits to it
    assert out.groupby("doc_id").size().max() == 3 and list(out.position) == list(range(1, len(out) + 1))
    assert (out.n_tokens.cumsum() == out.tokens_so_far).all() and out.virtual_finish.is_monotonic_increasing
    half = out.iloc[: len(out) // 2].groupby("source").n_tokens.sum()
    assert abs(half["b"] / half.sum() - 0.2) < 0.02
    reached = mixing.shares_reached(mixing.mix(docs, targets), targets.where("source is not null"), docs).collect()
    shares = {r["source"]: (r["share_reached"], r["most_uses"]) for r in reached}
    assert {r["source"]: (r["binds"], r["tokens_available"]) for r in reached} == {"a": (False, 3000), "b": (True, 300), "gone": (False, 0)}
    assert abs(shares["b"][0] - 0.2) < 0.01 and shares["b"][1] == 3 and shares["gone"] == (0.0, 0)
    assert rows(mixing.mix(docs, targets)) == rows(mixing.mix(docs.repartition(3), targets))
    assert mixing.mix(docs.where("false"), targets).count() == 0 and mixing.mix(docs, targets.where("false")).count() == 0


def test_mixture_of_a_greater_budget(spark):
    docs, targets = mixture_inputs(spark)
    out = mixing.mix(docs, targets, budget=2000).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()
    got = {r["source"]: r["t"] for r in out}
    assert got["b"] == 300 and 1690 <= got["a"] <= 1700
    with pytest.raises(ValueError):
        mixing.mix(docs, targets.unionByName(targets.where("source = 'a'")))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 1000), st.floats(0.01, 1.0), st.integers(1, 5)), min_size=1, max_size=6), st.integers(1, 5000))
def test_budget_is_used_up_where_it_can_be(sources, budget):
    tokens = {str(i): t for i, (t, _, _) in enumerate(sources)}
    plan = mixing.plan_mixture(tokens, {str(i): (w, r) for i, (_, w, r) in enumerate(sources)}, budget)
    used = sum(min(w * plan["until"], t * r) for t, w, r in sources)
    assert used == pytest.approx(min(budget, sum(t * r for t, _, r in sources)), rel=1e-6)


# 8 ---------------------------------------------------------------------------------------------------------------------


def documents(spark, texts):
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    return df.withColumns({"pair": F.lit(1), "here": F.lit(1), "first": F.lit(1)})


WHOLE = [
    "The old librarian sold the wooden bridge behind the station. Nobody had expected it.", "The bus driver cleaned the red sail in the town hall before noon.", "The old librarian in the town hall\nThe bus driver behind the station, 1990\nThe bus driver in the town hall",
    "The bus driver behind the station\nThe old librarian in the town hall", "The bus driver sold the wooden bridge in the town hall.\n— Motimive", "Nobody had expected it.\nhttps://example.org/abc", "Who cleaned the red sail?\n(Mala, 1965)", "Did it rain?", "长长的报告很快公布。", "Πόσο κράτησε;",
]


def test_truncation(spark):
    cut = ["Nobody had expected it. The old librarian sold the woo", "The bus driver cleaned the", "Nobody had expected it. The bus driver sold the red…", "长长的报告很快公布。很快公", "The bus driver cleaned the red sail [...]"]
    good = WHOLE * 3 + ["The bus driver in the town hall", "Did it rain? Nobody had expected it...", "", None, "***"]
    got = {r[0] for r in rows(truncation.judged(documents(spark, good + cut)), "doc_id")}
    assert got == set(range(len(good), len(good) + len(cut)))
    rates = truncation.truncation_rates(documents(spark, good + cut), truncation.judged(documents(spark, good + cut))).collect()
    assert [(r["n_docs"], r["n_truncated"]) for r in rates] == [(len(good) + len(cut), len(cut))]
    assert truncation.judged(documents(spark, good).where("false")).count() == 0


def brute_links(texts):
    """Every text against every longer one, character by character: what goes on, in a word, with a word, or not."""
    cut = {i: truncation.OMISSION.sub("", t).rstrip() for i, t in enumerate(texts) if t}
    out = {}
    for i, a in cut.items():
        closed = a.rstrip(truncation.BRACKETS)[-1:] in set(truncation.CLOSERS)
        if not any(c.isalpha() for c in a) or closed:
            continue
        for j, b in cut.items():
            if len(b) > len(a) and b.startswith(a):
                after = b[len(a) :]
                word = a[-1].isalnum() and after[0].isalnum()
                sentence = not word and bool(a[-1] in ",'-(" or after.lstrip(" ")[:1].isalpha() * (after[0] == " "))
                n, least, ids = out.get(i, ((0, 0, 0), None, []))
                out[i] = ((n[0] + word, n[1] + sentence, n[2] + (not word and not sentence)), None, [*ids, (not (word or sentence), j)])
    return sorted(((i, *n, min(ids)[1]) for i, (n, _, ids) in out.items()), key=repr)


def test_prefix_links_against_brute_force(spark):
    rng = random.Random(3)
    parts = ["ab", "b", " a", "\n", "1", " ", "c c", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))).strip() for _ in range(150)]
    texts = [t for t in texts if not t.endswith("..")] + [None, "", "..."]
    assert rows(truncation.prefix_links(documents(spark, texts))) == brute_links(texts)


def test_prefix_links(spark):
    long = "One sentence after the other, and each of them ends. " * 8
    df = documents(spark, [long, long[:250], long[:250] + "…", long[:100], "x" * 70_000, "x" * 300, None, long, long[:52]])
    assert [(r[0], r[4]) for r in rows(truncation.prefix_links(df))] == [(1, 0), (2, 0), (3, 0), (5, 4)]
    assert truncation.prefix_links(df.where("false")).count() == 0


@pytest.mark.parametrize("sign", ["", "…", "...", " ...", " [...]", " […]", " "])
def test_prefix_links_look_past_omission_signs(spark, sign):
    whole = "One sentence after the other, and each of them ends. " * 4 + "Then he walked home"
    df = documents(spark, [whole + " and slept.", whole[:-8] + sign, whole + sign, "The libra" + sign, "The librarian went home.", "Another text. " * 20, "Another text. " * 20 + "..."])
    assert [(r[0], r[4]) for r in rows(truncation.prefix_links(df))] == [(1, 0), (2, 0), (3, 4)]


def test_links_of_short_texts(spark):
    whole = ["He walked home and slept.", "The old librarian, who sold it, left.", "A well-known tourist came.", "The red sail\nIt was cleaned.", "The red sail (1970)", "Town hall, 1990", "Did it rain? Nobody knew.", "The bus driver", "The bus driver sold it.", "The bus driver\nHe sold it."]
    cut = ["He wal", "He walked...", "The old librarian", "The old librarian,", "A well-"]
    complete = ["The red sail", "Town hall", "Did it rain?", "***", "", None]
    df = documents(spark, whole + cut + complete)
    out = truncation.prefix_links(df)
    assert rows(out.where("n_word + n_sentence > 0 AND n_end = 0"), "doc_id") == [(i,) for i in range(len(whole), len(whole) + len(cut))]
    assert rows(out.where("doc_id = 11"), "doc_id", "n_sentence", "longer_doc_id") == [(11, 1, 0)]
    assert rows(out.where("n_end > 0"), "doc_id") == [(15,), (16,), (7,)]


def test_copies_of_a_cut_text_do_not_meet_one_by_one(spark):
    df = documents(spark, ["The old libra"] * 300 + ["The old librarian went home."] * 200)
    out = rows(truncation.prefix_links(df))
    assert len(out) == 300 and set(r[1:] for r in out) == {(200, 0, 0, 300)}


def test_routes(spark):
    lines = ["The old librarian\nAlways there", "Seen by the old librarian\nAlways there"] * 3
    texts = [*lines, "Yesterday came the old librarian", "Yesterday came the old librarian with keys and left.", "It rained. He went to the", "They brought bread,"]
    out = {r["doc_id"]: r["route"] for r in truncation.judged(documents(spark, texts)).collect()}
    assert (out[6], out[8], out[9]) == ("copy", "follows_sentence", "broken_sign")


def test_a_pile_of_one_length_is_a_limit(spark):
    """Lines that look complete, twelve of them of one length in one source, and two of the same kind of other lengths."""
    ends = ["The red sail in the town hall\nThe bus driver in the town hall\nNo more of it."] * 5
    rng = random.Random(8)
    name = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    piled, others = [f"Man {name(9)} in the town hall" for _ in range(12)], [f"Man {name(40)} in the town hall", f"Man {name(70)} in the town hall"]
    out = {r["doc_id"]: r["route"] for r in truncation.judged(documents(spark, ends + piled + others)).collect()}
    assert out == {i: "length_limit" for i in range(5, 17)}


def test_rates_are_bounded(spark):
    x, n = F.col("x").cast("double"), F.col("n").cast("double")
    df = spark.createDataFrame([(0, 60), (0, 61), (5, 0), (8, 8), (7, 7)], "x int, n int")
    out = df.select(truncation._upper(x, n, truncation.Z_OPEN), truncation._lower(x, n, truncation.Z_LIMIT)).collect()
    assert out[0][0] > truncation.MOST_OPEN > out[1][0] and out[2][0] is None and out[3][1] > truncation.LIMIT_SHARE > out[4][1]
