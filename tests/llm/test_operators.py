"""Every operator against brute force on one small table with null ids and texts, empty and very long
texts, repeated rows, ties and extra columns whose names clash with results."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tabloom.llm import (automaton_dedup, bpe, components, decontam, embed_join, langid, parity_join, ppm, queries, suffix_dedup,
                         toxicity, training_order)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, n_words int, `odd name` int"


def rows():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    para = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, base = para(90), para(200)
    out = [para(rng.randint(1, 150)) for _ in range(30)]
    out += [base, base, base.upper(), base.replace(words[3], "zzz", 1) + " tail", base + "\n" + para(5)]
    out += [para(20) + " " + shared + " " + para(30), shared, para(3) + "\t" + shared, "aa" * 600, "aa" * 600 + "b", "é" * 300, "x " * 500]
    out += ["", None, " \n\t ", "123 456 !!", " ".join(para(40) for _ in range(60)), "one", "one two", "one two", "naïve café   <|endoftext|> 日本語 😀"]
    data = [(i, t, ["en", "fr", None][i % 3], "s", len(t or ""), 1.0, "x", 3, i) for i, t in enumerate(out)]
    data += [data[3], data[30], (None, base, "en", "s", 1, 1.0, "x", 3, 9), (None, None, None, None, None, None, None, None, None)]
    rng.shuffle(data)
    return data


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield spark.createDataFrame(data, SCHEMA).repartition(3).cache()
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def components_of(sets, link):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if link(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def test_suffix_dedup_equals_brute_force(docs, data):
    threshold = 60
    texts = [(r[1] or "").encode() for r in data]
    seen = Counter(b[p:p + threshold] for b in texts for p in range(len(b) - threshold + 1))
    want = []
    for r, b in zip(data, texts):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - threshold + 1):
            if seen[b[p:p + threshold]] > 1:
                gone[p:p + threshold] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        want.append((r[0], len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    got = suffix_dedup.remove_repeats(docs, threshold)
    assert [(a, b, c, d, bytes(e)) for a, b, c, d, e in collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept")] == sorted(want, key=repr)


def test_suffix_dedup_finds_strings_with_few_phrases_at_a_texts_end(spark):
    """Copies whose last strings have only four or five phrases after their anchor lost bytes of those strings."""
    threshold, n = 60, 20000
    letters = np.random.RandomState(1).randint(97, 123, n * threshold).astype(np.uint8)
    begin = suffix_dedup.anchors(letters, np.arange(n + 1) * threshold, threshold)[-1]
    few = np.flatnonzero(np.diff(begin) - 1 < suffix_dedup.PHRASES + 2)
    assert len(few) > 20
    alone = [letters[k * threshold:(k + 1) * threshold].tobytes().decode() for k in few]
    long = [letters[k * threshold:(k + 3) * threshold].tobytes().decode() for k in few[:20] - 2]  # few phrases behind many
    docs = spark.createDataFrame([(k, t) for k, t in enumerate((alone + long) * 2)], "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(docs, threshold).collect()
    assert len(got) == 2 * len(alone + long)
    assert [r["doc_id"] for r in got if r["n_removed"] != r["n_bytes"] or r["kept"]] == []


def test_parity_join_equals_brute_force(docs, data):
    for n, percent in ((3, 90), (5, 80), (2, 50)):
        sets = {}
        for r in data:
            w = (r[1] or "").encode().lower().split()
            s = frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) or (frozenset({tuple(w)}) if w else frozenset())
            if r[0] is not None:
                sets[r[0]] = s
        link = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)
        root = components_of(sets, link)
        got = parity_join.near_duplicates(docs, n, percent).collect()
        assert len(got) == len(data)
        for r in got:
            assert r["component_id"] == (None if r["doc_id"] is None else root[r["doc_id"]])
            assert r["doc_id"] is None or r["n_shingles"] == len(sets[r["doc_id"]])


def test_pipeline_keeps_unrelated_texts_of_one_id(spark):
    import corpus_pipeline
    rng = random.Random(11)
    para = lambda: " ".join(f"w{rng.randint(0, 10 ** 6)}" for _ in range(120))
    a, b, c, d = (para() for _ in range(4))
    rows = [(5, a, "x"), (5, b, "x"), (5, a, "y"), (5, a, "x"), (3, b + " tail", "x"), (9, c, "x"), (4, c, "z"), (2, d, "x"), (2, d + " tail", "x"),
            (6, "", "x"), (7, None, "x"), (7, "", "x"), (None, a, "x"), (None, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    got = collected(got, "doc_id", "text", "lang")
    two = [r for r in got if r[0] == 2]
    assert len(two) == 1 and two[0][1] in (d, d + " tail")
    want = [(5, a, "x"), (3, b + " tail", "x"), (4, c, "z"), (6, "", "x"), (7, None, "x"), (7, "", "x"), (None, a, "x"), (None, a, "x")]
    assert sorted((r for r in got if r[0] != 2), key=repr) == sorted(want, key=repr)


def test_automaton_dedup_equals_brute_force(docs, data):
    first = {}
    for r in sorted((r for r in data if r[0] is not None), key=lambda r: r[0]):
        w = (r[1] or "").encode().split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), r[0])
    want = []
    for r in data:
        w = (r[1] or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12 if r[0] is not None else 0):
            if first[tuple(w[k:k + 13])] < r[0]:
                gone[k:k + 13] = [True] * 13
        text = b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else r[1]
        want.append((r[0], text, len(w), sum(gone)))
    got = automaton_dedup.remove_repeats(docs, 13)
    assert got.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_removed"]
    assert collected(got, "doc_id", "text", "n_words", "n_removed") == sorted(want, key=repr)


def test_automaton_dedup_sends_a_reference_once(spark, monkeypatch):
    rng = random.Random(5)
    long = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(3000)]
    own = lambda k: " ".join(f"d{k}n{j}" for j in range(10))
    rows = [(0, " ".join(long))] + [(k, f"{own(k)} {' '.join(long[30 * k:30 * k + 13 + k % 3])} {own(-k)}") for k in range(1, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    real, sent = automaton_dedup._against_references, []

    def spy(asked, min_words):
        sent.append(asked.agg(F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in asked.dtypes if kind == "string"))).first()[0])
        return real(asked, min_words)

    monkeypatch.setattr(automaton_dedup, "_against_references", spy)
    want = [0] + [13 + k % 3 for k in range(1, 90)]
    for asks, most in ((10_000, 2), (20, 30)):
        monkeypatch.setattr(automaton_dedup, "ASKS", asks, raising=False)
        got = automaton_dedup.remove_repeats(docs, 13).select("doc_id", "n_removed").collect()
        assert [n for _, n in sorted(tuple(r) for r in got)] == want
        assert sent.pop() < most * len(rows[0][1])


def test_automaton_dedup_looks_in_all_texts_of_the_reference(spark):
    one, two = (" ".join(f"{c}{j}" for j in range(30)) for c in "ab")
    rows = [(3, f"{one} x"), (3, f"{two} y"), (5, f"{two} z"), (6, f"u {one}"), (7, f"v {' '.join(two.split()[:20])}")]
    for texts in (rows, rows[::-1]):
        got = automaton_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), 13)
        assert collected(got, "doc_id", "n_removed") == [(3, 0), (3, 0), (5, 30), (6, 30), (7, 20)]


def test_suffix_automaton_statistics():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 14))] for _ in range(2))
        subs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        want = [max([n for n in range(1, i + 2) if tuple(b[i + 1 - n:i + 1]) in subs], default=0) for i in range(len(b))]
        assert automaton_dedup.SuffixAutomaton(a).statistics(b) == want


def test_bpe_equals_the_library_and_decodes(docs, data):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = []
    for r in data:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), ids, t.decode(ids, skip_special_tokens=False)))
    assert collected(bpe.encode_decode(docs, path, arrays=True), "doc_id", "n_tokens", "ids", "decoded") == sorted(want, key=repr)


def test_bpe_on_random_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(3)
    parts = list("abcdehiost  \n\t'  12$.,!éñß") + [" ", "\x85", "\x1c", "​", "漢", "😀", "<|endoftext|>", " the", " ing", "'s", "'ll", "　", "\xa0", "\0", "a" * 300]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    encoder = bpe.Encoder(bpe.Vocabulary(open(path, encoding="utf-8").read()), True)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["d", "text"])
    k = 0
    for part, buf, offs in bpe.chunks([batch], "text"):
        counts, ids, at, back, back_at = bpe.encode_part(part, buf, offs, encoder)
        for j in range(part.num_rows):
            want = t.encode(texts[k], add_special_tokens=False).ids
            assert ids[at[j]:at[j + 1]].tobytes().decode() == ",".join(map(str, want)) and counts[j] == len(want)
            assert back[back_at[j]:back_at[j + 1]].tobytes().decode() == t.decode(want, skip_special_tokens=False)
            k += 1


def test_ppm_base_equals_brute_force_and_distributions_sum_to_one(docs, data):
    training = docs.where("doc_id % 7 <> 2")
    model, words = ppm.learn(training)
    tokens = lambda t: (t or "").encode().lower().split() + ["END"]
    c = Counter(w for r in data if r[0] is not None and r[0] % 7 != 2 for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted(((r[0], len(tokens(r[1])), sum(c[w] > 0 for w in tokens(r[1])), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(r[1])), 6)) for r in data), key=repr)
    got = ppm.score(docs, model, words)
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got.collect()), key=repr) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got.collect())
    contexts = [r["c"] for r in words.grams.where(f"order = {ppm.ORDER}").select(F.shiftright("gram", 8).alias("c")).distinct().orderBy(F.xxhash64("c")).limit(20).collect()] + [0, 1 << 39]
    every = docs.sparkSession.createDataFrame([(c << 8 | b,) for c in contexts for b in range(256)], "gram long")
    sums = ppm._costs(words.grams, every).groupBy(F.shiftright("gram", 8)).agg(F.sum(F.pow(F.lit(10.0), "cost")).alias("p")).collect()
    assert len(sums) == len(contexts) and all(abs(r["p"] - 1) < 1e-9 for r in sums)
    known = {int(g): c for g, c in zip(model.grams, model.costs)}
    table = ppm.WindowCosts(model.grams, model.costs)
    asked = np.concatenate([model.grams, model.grams + 1, np.arange(99)])
    cost, hit = table.find(asked)
    assert hit.tolist() == [int(g) in known for g in asked] and cost.tolist() == [known.get(int(g), 0.0) for g in asked]


def ppm_brute_force(training, texts):
    """PPM of order 5, method C with exclusion, from every context of the training texts."""
    symbols = lambda t: [*(t or "").encode().lower(), 255]
    seen = {}
    for t in training:
        s = [255] * 5 + symbols(t)
        for k in range(5, len(s)):
            for o in range(6):
                seen.setdefault(tuple(s[k - o:k]), Counter())[s[k]] += 1

    def prob(context, b):
        p, out = 1.0, set()
        for o in range(len(context), -1, -1):
            left = {x: n for x, n in seen.get(tuple(context[len(context) - o:]), {}).items() if x not in out}
            if left:
                whole = sum(left.values()) + len(left)
                if b in left:
                    return p * left[b] / whole
                p *= len(left) / whole
                out |= set(left)
        return p / (256 - len(out))

    scores = []
    for t in texts:
        s = [255] * 5 + symbols(t)
        scores.append(sum(math.log10(prob(s[k - 5:k], s[k])) for k in range(5, len(s))))
    return scores


def test_ppm_score_equals_brute_force_whatever_is_broadcast(docs, data, monkeypatch):
    want = ppm_brute_force([r[1] for r in data if r[0] is not None and r[0] % 7 != 2], [r[1] for r in data])
    want = sorted((repr(r[0]), s) for r, s in zip(data, want))
    for known, windows in ((ppm.KNOWN, ppm.WINDOWS), (40, 200), (40, 0), (0, 0)):
        monkeypatch.setattr(ppm, "KNOWN", known)
        monkeypatch.setattr(ppm, "WINDOWS", windows)
        got = sorted((repr(r["doc_id"]), r["score"]) for r in ppm.score(docs, *ppm.learn(docs.where("doc_id % 7 <> 2"))).collect())
        assert [k for k, _ in got] == [k for k, _ in want]
        assert np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-9)


def test_language_and_toxicity(spark, docs):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(real.where("doc_id % 3 <> 1"), public_tokenizers.path("piece_bpe_32k.model"), 100)
    held = langid.predict(real.where("doc_id % 3 = 1"), model).join(real.select("doc_id", "lang"), "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    got = {r["doc_id"]: r for r in langid.predict(docs.where("doc_id is not null"), model).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id is not null").collect()}
    for k, r in got.items():
        assert (r["lang_pred"] == langid.UND) == (not any(ch.isalpha() for ch in texts[k] or "")) and 0 <= r["score"] <= 1
    assert langid.score_rows(docs, model).columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]
    lexicon = toxicity.learn(real, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = toxicity.score(docs, lexicon).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables hold out hardly any toxic row
    folds = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    marks = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").where("toxic is not null")
    judged = queries.QUERIES["op9_toxicity"](spark, sf).join(marks, "doc_id").withColumn("fold", folds).collect()
    assert all(r["held_out"] == (r["fold"] == 0) and r["predicted"] == (r["score"] >= 0.5) for r in judged)
    unseen = [r for r in judged if r["held_out"]]
    toxic, clean = ([r for r in unseen if r["toxic"] == y] for y in (1, 0))
    assert len(toxic) >= 50
    assert sum(r["predicted"] for r in toxic) >= 0.8 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.05 * len(clean)


def test_language_forward_sums_all_segmentations():
    table = langid.PieceTable.from_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.RandomState(0)
    probs = rng.rand(table.size, 2) / table.size
    for word in (b"a", b"thing", "naïve".encode(), b"ononon"):
        buf = np.frombuffer(word, np.uint8)
        prints = langid.Fingerprints(buf)

        def total(at, lang):
            if at == len(word):
                return 1.0
            s = 0.0
            for to in range(at + 1, min(len(word), at + langid.MAX_PIECE) + 1):
                i = table.find(prints.of(np.array([at]), np.array([to])), False)[0]
                s += probs[i, lang] * total(to, lang) if i >= 0 else 0
            return s

        got = langid.word_scores(table, probs, buf, prints, np.array([0]), np.array([len(word)]))[0]
        for lang in (0, 1):
            want = probs[table.mark, lang] * total(0, lang)
            for to in range(1, min(len(word), langid.MAX_PIECE) + 1):
                i = table.find(prints.of(np.array([0]), np.array([to])), True)[0]
                want += probs[i, lang] * total(to, lang) if i >= 0 else 0
            assert got[lang] == pytest.approx(math.log(want))


def test_toxicity_folds_and_exceptions():
    assert toxicity.fold("Ѕtupid 1d1ot!! l0ser, $$$x 42") == " stupid idiot loser x "
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " lowe": 2.0}, [" idiot proof "])
    assert toxicity.matches("an 1diot", lexicon)[0] == [3.0]
    assert toxicity.matches("idiot proof lowen", lexicon)[0] == [2.0]
    assert toxicity.matches("", lexicon)[0] == []


def test_embeddings_equal_brute_force(spark):
    rng = np.random.RandomState(5)
    centres = rng.randn(12, 16)
    data = []
    for i in range(400):
        v = centres[i % 12] + rng.randn(16) * (0.05 if i % 3 else 1)
        data.append((i, [float(x) for x in v], i % 3, "x"))
    data += [(400 + i, data[5][1], data[5][2], "x") for i in range(30)] + [(430, [x * 2 for x in data[7][1]], data[7][2], "x")]
    data += [(431, None, 1, "x"), (432, [0.0] * 16, 1, "x"), (433, [float("nan")] * 16, 1, "x"), (434, [None] + [1.0] * 15, 1, "x"),
             (435, data[5][1], None, "x"), (None, data[5][1], data[5][2], "x"), (436, [1.0, 0.0], 1, "x"), (437, [], 1, "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, kept string")
    ok = {r[0]: r for r in data[:431]}
    unit = {k: np.array(r[1]) / np.linalg.norm(r[1]) for k, r in ok.items()}
    link = lambda a, b: ok[a][2] == ok[b][2] and unit[a] @ unit[b] >= 0.98
    root = components_of({k: k for k in ok}, link)
    n = {a: sum(link(a, b) for b in ok if b != a) for a in ok}
    old = embed_join.CELL_ROWS, embed_join.BLOCK
    embed_join.CELL_ROWS, embed_join.BLOCK = 40, 50
    try:
        got = embed_join.range_join(df).collect()
    finally:
        embed_join.CELL_ROWS, embed_join.BLOCK = old
    assert len(got) == len(data)
    for r in got:
        k = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == ((n[k], root[k], root[k] == k) if k in ok else (0, k, k is not None))


def test_leaks_found_and_clean_documents_left_alone(spark, data):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(9001, None), (9002, ""), (None, "a b c d e f g")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(r[0], r[1], "x") for r in data if r[0] is not None]
    docs += [(1000 + k, " ".join(["filler words before"] * (k * 9)) + " " + items[k][1].encode().upper().decode() + " and after", "x") for k in range(12)]
    docs += [(2000, items[3][1][:len(items[3][1]) // 2], "x")]
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1000 + k, items[k][0]) for k in range(12)}


def test_pipeline_keeps_clean_documents_with_the_id_of_a_leak(spark, data):
    import corpus_pipeline
    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if r["text"])
    clean = [r[1] for r in data if r[0] is not None and r[1]][:6]
    rows = [(None, "before " + item + " after"), (7, item), (None, None)] + [(i, t) for i, t in zip((None, None, 7, 8, 9, None), clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(corpus_pipeline.benchmark_leaks(spark, docs, SF), "doc_id", "text") == sorted(rows[2:], key=repr)


def test_block_max_wand_equals_exhaustive_scoring():
    rng = random.Random(2)
    items = [(i, " ".join(f"w{int(rng.expovariate(0.1))}" for _ in range(rng.randint(3, 40)))) for i in range(150)]
    words = [decontam._words(t) for _, t in items]
    df = Counter(int(w) for x in words for w in np.unique(x).view(np.int64))
    shard = decontam.build_shard(items, df, len(items), float(np.mean([len(w) for w in words])), 64)
    for k in range(60):
        query = sorted(rng.sample(range(len(shard.terms)), rng.randint(1, 25)))
        score = Counter()
        for t in query:
            for i, g in zip(shard.postings[t][0], shard.postings[t][1]):
                score[i] += g
        for threshold in (0.1, 0.3, 0.6):
            assert sorted(i for i, _ in decontam.block_max_wand(shard, query, threshold)) == sorted(i for i, s in score.items() if s >= threshold - 1e-9)


def test_training_order_is_a_bijection_and_reads_back(spark, tmp_path):
    for n in (1, 2, 5, 1000, 4097):
        assert sorted(training_order.slots(np.arange(n), n, 3).tolist()) == list(range(n))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    place = training_order.shared_folder(spark)
    got = training_order.materialise(docs, place, 128, 1 << 14).collect()
    ids = training_order.read_slots(place, 0, 1 << 40)
    assert sorted(r["slot"] for r in got) == list(range(len(ids)))
    assert (training_order.read_slots(place, 7, 300) == ids[7:307]).all()
    by = {}
    for r in sorted(got, key=lambda r: r["seq"]):
        by.setdefault(r["doc_id"], []).append(ids[r["slot"]][:r["n_ids"]])
    for r in docs.collect():
        assert np.concatenate(by[r["doc_id"]]).tobytes() == (r["text"] or "").encode() + b"\xff"


def test_training_order_query_writes_the_ids_of_the_vocabulary(spark, docs, data, monkeypatch):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    end = t.token_to_id("<|endoftext|>")
    place = training_order.shared_folder(spark)
    got = training_order.materialise(docs, place, 16, 1 << 10, vocabulary_path=path, waves=3).collect()
    ids = training_order.read_slots(place, 0, 1 << 40)
    assert sorted(r["slot"] for r in got) == list(range(len(ids)))
    assert all((ids[r["slot"]][r["n_ids"]:] == end).all() for r in got)
    want = [(repr(r[0]), t.encode(r[1] or "", add_special_tokens=False).ids + [end]) for r in data]
    want = Counter((k, j, tuple(x[16 * j:16 * j + 16])) for k, x in want for j in range(-(-len(x) // 16)))
    assert Counter((repr(r["doc_id"]), r["seq"], tuple(ids[r["slot"]][:r["n_ids"]].tolist())) for r in got) == want
    place = training_order.shared_folder(spark)
    monkeypatch.setattr(training_order, "shared_folder", lambda spark: place)
    rows = queries.QUERIES["op8_training_order"](spark, SF).collect()
    ids = training_order.read_slots(place, 0, 1 << 40)
    by = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        by.setdefault(r["doc_id"], []).extend(ids[r["slot"]][:r["n_ids"]].tolist())
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert by[r["doc_id"]] == t.encode(r["text"] or "", add_special_tokens=False).ids + [end]


def test_training_order_ids_by_either_encoder():
    source = training_order._source(public_tokenizers.path("byte_bpe_50k.json"))
    vocabulary, encoding = training_order._loaded(source)
    assert encoding is not None
    rng = random.Random(8)
    parts = ["a", "the", " ", "  ", "\n", "'s", "é", "中", "😀", "\u00a0", "12", "<|endoftext|>", "<|endo", "\x1c", "\x85", "\u0301", "x" * 300]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["ab" * 40_000]
    for text in texts:
        assert list(training_order._text_ids(text, vocabulary, encoding)) == vocabulary.encode(text)
    text = " " * 1_000_000 + "x"  # refused by the library's pattern matcher
    with pytest.raises(ValueError):
        encoding.encode_to_numpy(text, allowed_special="all")
    assert list(training_order._text_ids(text, vocabulary, encoding)) == vocabulary.encode(text)


def test_training_order_of_no_rows_and_of_a_dead_job(spark, docs, monkeypatch):
    place = training_order.shared_folder(spark)
    assert training_order.materialise(docs.where("false"), place, 16, 1 << 10).count() == 0
    assert training_order.read_slots(place, 0, 1 << 40).shape == (0, 16)
    place = training_order.shared_folder(spark)

    def dies(*tables):
        raise RuntimeError("lost")

    monkeypatch.setattr(training_order, "release", dies)
    with pytest.raises(RuntimeError):
        training_order.materialise(docs, place, 16, 1 << 10)
    with pytest.raises(OSError):  # no manifest promises shards that were not written
        training_order.read_slots(place, 0, 1)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (6, 5)], "a long, b long")
    assert {r["node"]: r["component"] for r in components.connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5}


def test_components_read_fewer_edges_each_round(spark, monkeypatch):
    """pipeline: edges within a tree are gone after the round that made it; every round used to read all of them."""
    rng = random.Random(2)
    near = [(h, 1000 + k) for k in range(400) for h in rng.sample(range(40), 3)] + [(k, k + 1) for k in range(3000, 3060)]
    edges = spark.createDataFrame(near, "a long, b long")
    sizes, plain = [], components.cut_lineage

    def counted(df):
        out = plain(df)
        if out.columns == ["a", "b"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(components, "cut_lineage", counted)
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {x: (0 if x < 3000 else 3000) for e in near for x in e}
    assert len(sizes) > 1 and sum(sizes[1:]) < sizes[0] / 2


def test_suffix_dedup_takes_runs_without_python_objects():
    """op3: lists of runs and their strings are flat arrays (they used to be a Python object each), with nulls and slices."""
    import pyarrow as pa
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    lists = pa.array([[{"start": 9, "stop": 10}], None, [{"start": 1, "stop": 3}, {"start": 5, "stop": 6}], []], kind)
    for part, rows, starts, stops in ((lists, [0, 2, 2], [9, 1, 5], [10, 3, 6]), (lists.slice(1, 3), [1, 1], [1, 5], [3, 6]), (lists.slice(1, 1), [], [], [])):
        runs, k = suffix_dedup._flat(part)
        start, stop = suffix_dedup._bounds(runs)
        assert (k.tolist(), start.tolist(), stop.tolist()) == (rows, starts, stops)


def test_anchors_equal_their_definition():
    rng = np.random.RandomState(3)
    for threshold in (20, 60):
        w = suffix_dedup.window_of(threshold)
        sizes = [0, 3, threshold - 1, threshold, 5 * threshold, 1, 2 * threshold]
        offs = np.concatenate([[0], np.cumsum(sizes)])
        buf = rng.randint(97, 100, offs[-1]).astype(np.uint8)
        grams = np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))
        rank = suffix_dedup.mix64(grams) >> np.uint64(32)
        want = []
        for d in range(len(sizes)):
            for s in range(offs[d], offs[d + 1] - w - 6):
                pick = min(range(s, s + w), key=lambda p: (rank[p], p))
                if not want or want[-1][:2] != [pick, d]:
                    want.append([pick, d, s, -1])
                if s + threshold <= offs[d + 1]:
                    want[-1][3] = s
        at, doc, low, high, begin = suffix_dedup.anchors(buf, offs, threshold)
        assert [[a, d] for a, d in zip(at, doc)] == [x[:2] for x in want]
        assert [(lo, hi) for lo, hi in zip(low, high) if lo >= 0] == [(x[2], x[3]) for x in want if x[3] >= 0]
        assert begin.tolist() == [sum(x[1] < d for x in want) for d in range(len(sizes) + 1)]


def test_empty_tables(spark, docs):
    none = docs.where("false")
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = langid.learn(none, path)
    assert langid.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, model).collect()} == {langid.UND}
    ppm_model, words = ppm.learn(none)
    assert ppm.score(none, ppm_model, words).count() == 0 and ppm.score(docs, ppm_model, words).count() == docs.count()
    assert suffix_dedup.remove_repeats(none, 400).count() == 0
    assert parity_join.near_duplicates(none).count() == 0
    assert automaton_dedup.remove_repeats(none).count() == 0
    assert bpe.encode_decode(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert decontam.find_leaks(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert embed_join.range_join(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.learn(docs, labels)).count() == docs.count()


def test_queries_and_pipeline_are_registered(spark):
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
    assert hashlib.sha256(b"").hexdigest() in {r["kept_sha256"] for r in queries.QUERIES["op3_suffix_dedup"](spark, SF).where(F.col("n_bytes") == F.col("n_removed")).collect()} | {hashlib.sha256(b"").hexdigest()}


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == docs.columns
        now = spark.createDataFrame(after.collect(), docs.schema)
        assert 0 < now.count() <= docs.count(), name
    ids = [r["doc_id"] for r in now.collect()]
    assert len(ids) == len(set(ids))
    assert parity_join.near_duplicates(now, 5, 80).where("doc_id <> component_id").count() <= now.count()
    assert corpus_pipeline.run(spark, SF).count() == len(ids)


def thue_morse():
    """Two texts of one length and head whose polynomial fingerprints modulo 2^64 agree for every base."""
    line = [bin(k).count("1") % 2 for k in range(2048)]
    return ["c" * 8 + "".join("ab"[x ^ flip] for x in line) for flip in (0, 1)]


def test_regular_strings_are_told_apart(spark):
    from tokenizers import Tokenizer
    from tabloom.llm.common import Fingerprints
    one, two = thue_morse()
    buf = np.frombuffer((one + two).encode(), np.uint8)
    a = np.array([0, len(one)])
    prints = Fingerprints(buf)
    assert len(set(prints.of(a, a + len(one)).tolist())) == 2 == len(set(prints.raw(a, a + len(one)).tolist())) == len(set(prints.spare(a, a + len(one)).tolist()))
    rows = [(k, t) for k, t in enumerate([one, two, one, f"x {two} y", f"x {one} y"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in bpe.encode_decode(docs, path).collect():
        want = library.encode(rows[r["doc_id"]][1], add_special_tokens=False).ids
        assert (r["ids"], r["decoded"]) == (",".join(map(str, want)), rows[r["doc_id"]][1])
    model, words = ppm.learn(docs.where("doc_id = 0"))
    known = {r["doc_id"]: r["n_known"] for r in ppm.score(docs, model, words).collect()}
    assert known == {0: 2, 1: 1, 2: 2, 3: 1, 4: 2}
    long = [(k, " ".join(f"w{k}{j}" for j in range(40)) + f" {t} " + "same tail of words here and so on for a while yes it is") for k, t in enumerate((one, two, one))]
    kept = {r["doc_id"]: r["n_removed"] for r in automaton_dedup.remove_repeats(spark.createDataFrame(long, "doc_id long, text string"), 13).collect()}
    assert kept[0] == 0 and kept[2] == kept[1] + 1
    linked = {r["doc_id"]: r["component_id"] for r in parity_join.near_duplicates(docs.where("doc_id < 3"), 3, 90).collect()}
    assert linked == {0: 0, 1: 1, 2: 0}


def test_a_wrong_memo_hit_is_noticed(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        source = f.read()
    texts = ["same words here", "other text, ünlike", "", "same again", "other text, ünlike"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    for csv in (True, False):
        want = bpe.Encoder(bpe.Vocabulary(source), csv).encode(buf, offs)
        with monkeypatch.context() as m:
            m.setattr(bpe.Fingerprints, "of", lambda self, a, b: (b - a).astype(np.uint64))
            got = bpe.Encoder(bpe.Vocabulary(source), csv).encode(buf, offs)
        assert [x.tolist() for x in got] == [x.tolist() for x in want]
