"""The corpus operators against brute force, exact round trips and held-out accuracy on small tables."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from panelwright.llm import bpe, counts, fertility, language, near, nearest, packing, quality, repeats, toxicity, trees  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, score double"
WORDS = ["the", "of", "stone", "river", "Straße", "été", "don't", "漢字", "x_y", "12,5", "…", "A", "b|c"]


def texts(seed: int, n: int = 60) -> list[str | None]:
    r = random.Random(seed)
    fixed = [None, "", " \n\t ", "word", "a b c d", "  double  space \n\n end ", "é" * 300, "ab" * 500, "<|endoftext|> İ ǅ", "🙂 x"]
    passage = " ".join(r.choice(WORDS) + str(i) for i in range(80))
    made = []
    for _ in range(n):
        body = " ".join(r.choice(WORDS) * r.randint(1, 2) for _ in range(r.randint(0, 200)))
        made.append(body + r.choice(["", "\n" + passage, " " + passage[: r.randint(1, 300)]]))
    return fixed + made + made[:5] + [None, "word"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, ("en", "de", None)[i % 3], "src0", 0.5) for i, t in enumerate(texts(1))]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def raw(docs):
    return {r["doc_id"]: (r["text"] or "") for r in docs.collect()}


# Byte-level BPE


def test_bpe_equals_the_reference_tokenizer_and_decodes(docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.encode_and_decode(docs, path, public.PATTERN), "ids", "decoded")
    assert len(got) == docs.count()
    for doc, text in raw(docs).items():
        assert got[doc] == (known.encode_ordinary(text), text.encode())
    assert bpe.encode_and_decode(empty, path, public.PATTERN).count() == 0


def test_long_words_merge_equal_pairs_together():
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    merges, r = bpe.ByteMerges(path, public.PATTERN), random.Random(5)
    words = ["a" * 301, "ab" * 200, "日本" * 60] + ["".join(r.choice("etaoinsh") for _ in range(200)) for _ in range(20)]
    for word, (ids, decoded) in zip(words, merges.encode(words), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == known.encode_ordinary(word)
        assert decoded == word.encode()


# Packing


def test_packing_is_gapless_and_keeps_every_token(docs, empty):
    path = public.path("word_bpe_49k.json")
    rows = packing.pack_documents(docs, path, capacity=64, open_bins=8).collect()
    known = tokenizers.Tokenizer.from_file(path)
    known.encode_special_tokens = True
    pieces, bins = defaultdict(dict), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]][r["piece"]] = r
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in raw(docs).items():
        ids = [*known.encode(text, add_special_tokens=False).ids, 0]
        got = [pieces[doc][k] for k in range(len(pieces[doc]))]
        assert [r["start"] for r in got] == list(range(0, len(ids), 64))
        for r in got:
            cut = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(cut)
        assert sum(r["length"] for r in got) == len(ids)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(empty, path).count() == 0


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    fit = packing.BestFit(10, 2, 0)
    assert [fit.place(n)[0] for n in (7, 4)] == [0, 1]
    assert fit.place(3) == (0, 7)  # fills bin 0
    assert fit.place(8)[0] == 2
    assert fit.place(9)[0] == 3  # two open: the fullest, bin 2, closes
    assert fit.place(6) == (1, 4)
    r = random.Random(1)
    many = packing.BestFit(100, 64, 0)
    sizes = [r.randint(1, 60) for _ in range(5000)]
    for n in sizes:
        many.place(n)
    assert many.next <= 1.03 * sum(sizes) / 100 + 1


# Token counts


def test_token_counts_equal_a_plain_dynamic_program(docs, empty):
    path = public.path("piece_bpe_32k.model")
    pieces, byte = counts.piece_scores(path)

    def plain(word):
        s = "▁" + word
        best = [(0.0, 0)]
        for e in range(1, len(s) + 1):
            n = len(s[e - 1].encode())
            ways = [(best[e - 1][0] + n * byte, best[e - 1][1] - n)]
            ways += [(best[k][0] + pieces[s[k:e]], best[k][1] - 1) for k in range(e) if s[k:e] in pieces]
            best.append(max(ways))
        return -best[-1][1]

    got = by_id(counts.token_counts(docs, path), "n_words", "n_tokens")
    for doc, text in raw(docs).items():
        words = [w.decode() for w in text.encode().split()]
        if len(text) < 600:
            assert got[doc] == (len(words), sum(map(plain, words)))
    assert counts.token_counts(empty, path).count() == 0


# Quality rules


def test_quality_rules_count_as_defined(docs, empty):
    path = public.path("piece_bpe_32k.model")
    rows = {r["doc_id"]: r for r in fertility.judge(docs, path).collect()}
    for doc, text in raw(docs).items():
        words = text.encode().split()
        lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
        windows = defaultdict(list)
        for i in range(len(words) - 2):
            windows[tuple(words[i : i + 3])].append(i)
        covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
        r = rows[doc]
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(len(w.decode()) for w in words)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r["kept"] and r["base_failed"])
    assert fertility.judge(empty, path).count() == 0
    assert fertility.judge(docs.drop("lang"), path).count() == docs.count()


def test_bands_go_by_language_then_script(spark):
    good = " ".join(f"stone{i} walks{i * 7} along{i * 3}" for i in range(40))
    df = spark.createDataFrame([(1, good, "xx"), (2, good, None)], "doc_id long, text string, lang string")
    path, wide, narrow = public.path("piece_bpe_32k.model"), fertility.Band(0, 99, 1, 0), fertility.Band(50, 99, 1, 0)
    assert by_id(fertility.judge(df, path, {"xx": narrow, "": wide}), "kept") == {1: (False,), 2: (True,)}
    assert by_id(fertility.judge(df, path, {"latin": narrow, "xx": wide, "": wide}), "kept") == {1: (True,), 2: (False,)}


def test_fitted_floors_reject_junk_and_keep_clean_text_of_held_out_rows(spark):
    r = random.Random(12)
    syllables = "the and ing tion er on re st en al ma ri to de sa ble con ter".split()
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(3000)]
    ranks = [1 / (i + 5) for i in range(3000)]
    rows, labels = [], []
    for i in range(600):
        text, junk = r.choices(words, ranks, k=r.randint(60, 600)), r.random() < 0.25
        if junk:
            text = [w + r.choice(["###", "$$$", "%%%", "&&&"]) for w in text]
        rows.append((i, " ".join(text), r.choice(["en", None])))
        labels.append((i, int(not junk), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    path = public.path("piece_bpe_32k.model")
    floors = fertility.fit_floors(docs, labels, path)
    assert set(floors) == {("lang", "en"), ("script", "latin")}
    judged = fertility.judge(docs, path, floors=floors).where(trees.held_out()).join(labels, "doc_id")
    shares = {x["quality"]: x["kept"] for x in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert shares[1] > 0.95 and shares[0] < 0.1
    left = {x[0] for x in fertility.accepted(docs, path, floors=floors).select("doc_id").collect()}
    assert left == {x["doc_id"] for x in fertility.judge(docs, path, floors=floors).where("kept").collect()}
    assert fertility.fit_floors(docs.limit(0), labels, path) == {}
    assert fertility.fit_floors(docs.drop("lang"), labels, path).keys() == {("script", "latin")}


# Language identification


def test_language_of_held_out_documents(spark, empty):
    r = random.Random(4)
    stems = {"aa": ["kelo", "miru", "tana", "sovi"], "bb": ["grund", "stark", "fluss", "berg"]}
    rows = [
        (i, " ".join(r.choice(stems[x]) + r.choice("abcdefgh") for _ in range(30)), x)
        for i in range(120)
        for x in [r.choice(["aa", "bb"])]
    ]
    df = spark.createDataFrame(rows + [(1000, None, "aa"), (1001, "12 34 !!", None), (1002, "漢字", None)], "doc_id long, text string, lang string")
    model = language.fit_languages(df, ~language.held_out())
    got = by_id(language.predict_languages(df, model), "lang_pred", "score")
    assert all(got[i][0] == x for i, _, x in rows)
    assert got[1000] == ("und", 0.0) and got[1001] == ("und", 0.0)
    assert got[1002][0] in ("aa", "bb")
    none = language.fit_languages(empty, ~language.held_out())
    assert by_id(language.predict_languages(df, none), "lang_pred")[0] == ("und",)
    assert language.predict_languages(empty, model).count() == 0


def test_rare_languages_are_learned_and_unseen_scripts_stay(spark, empty):
    r = random.Random(8)

    def text(stems):
        return " ".join(r.choice(stems) + r.choice("abcdefgh") for _ in range(30))

    rows = [(i, text(["kelo", "miru", "tana"]), "aa") for i in range(600)]
    rows += [(i, text(["grund", "stark", "fluss"]), "bb") for i in range(600, 606)]
    rows += [(i, " ".join(r.choice(["река", "камень", "утро"]) for _ in range(30)), None) for i in range(700, 705)]
    rows += [(800, "12 34 !!", None), (801, None, "aa"), (802, " ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    train = F.lit(True)
    sample = language.bounded_sample(df, F.col("lang").isNotNull(), 40)
    assert {x["lang"]: x["count"] for x in sample.groupBy("lang").count().collect()} == {"aa": 40, "bb": 6}
    model = language.fit_languages(df, train, most_docs=40)
    assert model.languages == ["aa", "bb"]
    got = by_id(language.predict_languages(df, model), "lang_pred")
    assert all(got[i] == (x,) for i, _, x in rows if i < 700)
    wanted = {i for i, _, _ in rows if i < 705}
    many = language.LanguageModel(["aa", "bb", "cc", "dd"], {k: {w: (*v, -9.0, -9.0) for w, v in d.items()} for k, d in model.odds.items()})
    for m in (model, many, language.fit_languages(empty, train), language.fit_languages(df.withColumn("lang", F.lit(None).cast("string")), train)):
        assert {x[0] for x in language.recognised(df, m).select("doc_id").collect()} == wanted
    against = language.LanguageModel(["aa", "bb", "cc"], {0: {}, 4: {}, 3: {}, 2: {}, 1: {c: (0.0, 0.0, 0.0) for c in "abcdefghijklmnopqrstuvwxyz"}})
    assert {x[0] for x in language.recognised(df, against).select("doc_id").collect()} == set(range(700, 705))


def test_unseen_words_fall_back_to_shorter_grams():
    odds = {0: {"known": (1.0, -1.0)}, 4: {"<abc": (0.5, -0.5)}, 3: {}, 2: {}, 1: {"z": (-2.0, 2.0)}}
    model = language.LanguageModel(["aa", "bb"], odds)
    assert model.word("known") == (1.0, -1.0)
    assert model.word("abcd") == (0.5, -0.5)
    assert model.word("zz") == (-2.0, 2.0)
    assert model.word("q") == (0.0, 0.0)


# Near-duplicates


def plain_components(rows, size, percent):
    sets = {}
    for doc, text in rows.items():
        w = text.encode().lower().split()
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
        sets[doc] = grams
    label = {d: d for d in sets}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a2, b2 = top(a), top(b)
                label[max(a2, b2)] = min(a2, b2)
    return {d: (len(sets[d]), top(d), top(d) == d) for d in sets}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_equal_brute_force(spark, docs, empty, size):
    r = random.Random(size)
    base = [f"w{r.randint(0, 400)}" for _ in range(120)]
    rows = dict(raw(docs))
    for i in range(120):  # a chain of edits, and copies of it in capitals
        words = list(base)
        for _ in range(r.randint(0, 9)):
            words[r.randrange(len(words))] = f"v{r.randint(0, 99)}"
        if r.random() < 0.3:
            base = words
        rows[5000 + i] = " ".join(words).upper() if i % 7 == 0 else " ".join(words)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    got = by_id(near.near_duplicates(df, size, 80), "n_shingles", "component_id", "kept")
    assert got == plain_components(rows, size, 80)
    assert near.near_duplicates(empty, size, 80).count() == 0


def test_one_row_of_each_group_stays_whatever_its_key(spark):
    r = random.Random(21)
    base = [[f"w{r.randrange(5000)}" for _ in range(200)] for _ in range(5)]

    def changed(words, k):
        return " ".join(words[:k] + ["other"] + words[k + 1 :])

    a, b, c, d, e = (" ".join(x) for x in base)
    rows = [(None, a, "unique text, no key"), (7, b, "x"), (7, b, "x"), (7, b, "x"), (3, changed(base[1], 50), "least key")]
    rows += [(7, c, "other text under the key"), (None, d, "y"), (None, changed(base[3], 9), "y"), (None, e, "z"), (1, e, "key before none")]
    rows += [(None, "", "blank"), (None, None, "blank")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    left = sorted(x["row"] for x in near.distinct_rows(docs, 4, 80).collect())
    assert left == sorted(["unique text, no key", "least key", "other text under the key", "y", "key before none", "blank", "blank"])


def test_links_run_through_texts_without_a_key(spark):
    words = [f"w{i}" for i in range(120)]
    step = [" ".join([f"x{i}" for i in range(k)] + words[k:]) for k in (0, 10, 18)]
    assert plain_components({0: step[0], 2: step[2]}, 4, 80)[2][1] == 2
    docs = spark.createDataFrame([(0, step[0]), (None, step[1]), (2, step[2])], "doc_id long, text string")
    got = by_id(near.near_duplicates(docs, 4, 80), "component_id", "kept")
    assert got == {0: (0, True), None: (0, False), 2: (0, False)}


# Repeats


def plain_repeats(rows, window):
    first = {}
    for doc in sorted(rows):
        b = rows[doc].encode()
        for i in range(len(b) - window + 1):
            first.setdefault(b[i : i + window], doc)
    out = {}
    for doc, text in rows.items():
        b = text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < doc:
                gone[i : i + window] = b"\1" * window
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = (len(b), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("block", [900, 1 << 20])
def test_repeats_equal_brute_force(spark, docs, empty, block):
    rows = raw(docs)
    left = repeats.remove_repeats(docs, block_bytes=block).withColumn("n", F.size("spans"))
    assert by_id(left, "n_bytes", "n", "kept") == plain_repeats(rows, 50)
    assert {"lang", "source", "score"} <= set(left.columns)
    assert repeats.remove_repeats(empty).count() == 0


def test_rows_without_doc_id_keep_their_text(spark):
    text = "a passage that is long enough to be found twice, and then some more of it"
    rows = [(1, text), (None, text), (2, "x " + text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(repeats.remove_repeats(df), "kept") == {1: (text.encode(),), None: (text.encode(),), 2: (b"x ",)}


# Nearest neighbours


def test_search_reaches_the_exact_neighbours(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 32))
    data = centres[r.integers(0, 12, 900)] + 0.4 * r.normal(size=(900, 32))
    data[100:400] = data[100]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(2000, None), (2020, [0.0] * 32), (2040, [float("nan")] * 32), (2060, [1.0]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for x in nearest.search(df, F.col("vec_id") % 20 == 0, block_rows=256).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    assert sorted(got) == list(range(0, 900, 20))
    hit = 0
    for q, found in got.items():
        score = data @ data[q]
        best = [i for i in np.lexsort((np.arange(900), -score)) if i != q][:20]
        hit += len({i for _, i, _ in found} & set(best))
        assert [k for k, _, _ in found] == list(range(1, 21))
        assert all(abs(s - score[i]) < 1e-9 for _, i, s in found)
    assert hit >= 0.9 * 20 * len(got)
    assert [i for _, i, _ in got[100]] == list(range(101, 121))
    few = spark.createDataFrame(rows[:3], df.schema)
    assert [x["vec_id"] for x in nearest.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] != []
    assert nearest.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_index_finds_every_code_within_the_radius():
    r = np.random.default_rng(1)
    codes = r.integers(0, 256, (500, 4)).astype(np.uint8)
    index = nearest.MultiIndex(codes)
    for radius in (0, 3, 9, 14):
        q = codes[radius]
        near_ = [i for i, c in enumerate(codes) if sum(bin(int(x)).count("1") for x in c ^ q) <= radius]
        assert index.within(q, radius).tolist() == near_


# Classifiers


def test_trees_learn_an_interaction_and_isotonic_rates_rise():
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = trees.fit_trees(x[:2000], y[:2000])
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    points, rates = trees.isotonic(model.margin(x[2000:]), y[2000:])
    assert (np.diff(points) > 0).all() and (np.diff(rates) >= -1e-9).all() and rates.min() >= 0 and rates.max() <= 1
    assert trees.fit_trees(x[:0], y[:0]).probability(x[:3]).tolist() == [0.5] * 3
    assert len(trees.fit_trees(x, np.ones(3000)).feature) == 0


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        words = [r.choice(["river", "stone", "walks", "along", "green", "valley", "you"]) + r.choice(["", "s", "ed"]) for _ in range(80)]
        bad, toxic = r.random() < 0.3, r.random() < 0.3
        if bad:
            words = [w + "%%%" for w in words]
        if toxic:
            for _ in range(4):
                words[r.randrange(80)] = r.choice(["blorgface", "snivelrat", "bl0rgf4ce"])
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(900, None, None), (901, "", None)]
    labels += [(900, None, 1), (5, 1, None)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, lang string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_classifiers_on_held_out_rows(labelled, empty):
    docs, labels = labelled
    truth = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    q = by_id(quality.score_quality(docs, quality.fit_quality(docs, labels)), "score")
    t = by_id(toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)), "score")
    out = {r["doc_id"] for r in docs.where(trees.held_out()).collect()} - {5, 900, 901}
    assert len(out) > 40
    assert all((q[d][0] >= 0.3) == truth[d][0] for d in out)
    assert np.mean([(t[d][0] >= 0.5) == truth[d][1] for d in out]) > 0.95
    for scores in (q, t):
        assert len(scores) == 402 and all(0 <= s[0] <= 1 for s in scores.values())
    none = quality.fit_quality(empty, labels.limit(0))
    assert by_id(quality.score_quality(docs, none), "score")[0] == (0.5,)
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(docs, labels.limit(0))).count() == 0


def test_disguised_spellings_and_second_person_count():
    marks = toxicity.WordMarks({"snivel$": 3.0})
    x = dict(zip(toxicity.FEATURES, marks.features(b"you are a sn1vel and SNIVEL, they say"), strict=True))
    assert x["disguised"] == 1 / 8 and x["lexicon"] == 1 / 8 and x["near_share"] == 1.0 and x["shouted"] == 1 / 8
    assert marks.features(b"") == [0.0] * len(toxicity.FEATURES)


def test_digest_of_ids_is_that_of_joined_decimals(spark):
    df = spark.createDataFrame([([1, 20, 3],), ([],)], "ids array<int>")
    got = [r[0] for r in df.select(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)).collect()]
    assert got == [hashlib.sha256(s).hexdigest() for s in (b"1,20,3", b"")]
