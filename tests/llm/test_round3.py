"""Decontamination, alignment of tokens and spelling variants, against plain loops on awkward rows."""

import bisect
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from recordmill.llm import alignment as A, contamination as C, variants as V
from tests.llm.cases import LONG, docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- operator 11

ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog by the river bank today."),
    (2, "the QUICK brown fox jumps over the lazy dog by the river bank today"),  # the same words
    (3, "mot"),  # a window of one word
    (4, None),
    (5, ""),
    (6, "12345"),
    (7, LONG[:4000]),
    (None, "le petit chat est sur la table de la maison avec le chien"),
    (8, "été NOëL größe 9"),
]


def plain_hits(text, items):
    words, covered, found = WORD.findall(low(text)), set(), set()
    for item, own in items:
        ws = WORD.findall(low(own))
        k = min(10, len(ws))
        if not k:
            continue
        windows = {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                covered |= set(range(i, i + k))
                found.add("" if item is None else str(item))
    return words, covered, sorted(found)


@pytest.fixture(scope="module")
def contaminated(spark):
    more = [(20, "so été Noël größe 9 and xété noël größe 9", "fr", "a", 1), (21, LONG[:9000] + " mot " + LONG[:700], "de", "a", 1), (22, "Mot.mot,MOT", None, None, 3)]
    from tests.llm.cases import DOCS

    return docs(spark, DOCS + more), spark.createDataFrame(ITEMS, "item_id long, text string")


def digest(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("most", [C.BENCHMARK_WORDS, 0])
def test_hits_equal_a_plain_scan(spark, contaminated, most):
    d, b = contaminated
    got = [(r.doc_id, r.n_words, [(s.start, s.end) for s in r.spans], r.n_hit, r["items"], r.contaminated) for r in C.contamination(d, b, benchmark_words=most).collect()]
    want = []
    for r in d.select("doc_id", "text").collect():
        words, covered, found = plain_hits(r.text, ITEMS)
        spans, run = [], None
        for p in sorted(covered):
            if run and run[1] == p:
                run[1] = p + 1
            else:
                spans.append(run := [p, p + 1])
        want.append((r.doc_id, len(words), [tuple(s) for s in spans], len(covered), found, bool(covered)))
    assert digest(got) == digest(want)
    assert sum(x[5] for x in want) >= 6


def test_contract_columns_equal_sql(spark, contaminated):
    d, b = contaminated
    rows = digest(C.op11(d, b).collect())
    duck = duckdb.connect()
    for name, frame in (("documents", d.select("doc_id", "text").toPandas()), ("benchmark", b.toPandas())):
        duck.register(name, frame)
    assert digest(duck.sql(C.OP11_SQL.replace("item_id::VARCHAR", "item_id::BIGINT::VARCHAR").replace("doc_id,", "doc_id::BIGINT AS doc_id,", 1)).fetchall()) == rows


def test_spans_and_documents_are_removed(spark, contaminated):
    d, b = contaminated
    clean = C.without_spans(d, b)
    assert clean.columns == d.columns and clean.count() == d.count()
    assert not C.contamination(clean, b).where("contaminated").count()
    old, new = ({r.doc_id: r.text for r in x.where("doc_id > 19").collect()} for x in (d, clean))
    assert new[20] == "so and xété noël größe 9" and new[22] == "" and old[22] == "Mot.mot,MOT"
    shuffled = C.without_spans(d, b, broadcast_spans=0)
    assert digest(shuffled.collect()) == digest(clean.collect())
    kept = {r.doc_id for r in C.without_documents(d, b).collect()}
    assert kept == {r.doc_id for r in d.collect() if not plain_hits(r.text, ITEMS)[1]}
    assert 20 in {r.doc_id for r in C.without_documents(d, b, share=0.6).collect()}


def test_no_items_no_documents(spark, contaminated):
    d, b = contaminated
    assert not C.op11(d, b.where("false")).where("contaminated").count() and C.op11(d, b.where("false")).count() == d.count()
    assert C.op11(d.where("false"), b).count() == 0
    assert C.without_spans(d, b.where("false")).count() == d.count()


def test_decontamination_needs_no_python_and_no_text_in_a_shuffle(spark, contaminated):
    plan = C.op11(*contaminated)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan and "NestedLoop" not in plan


# ---- operator 12

public = pytest.importorskip("public_tokenizers")
A_PATH, B_PATH = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "\n", "a", " a", "a ", "a  b\n\n c\t\td ", "The quick brown fox", "The quick brown fox", "don't they'll  go", "x y 　z", "▁", "a ▁ b", "<0x41> <s> </s> <unk> <|endoftext|>", "\x00 a\x00b",
    "Größe naïve Œuvre 北京大学 и мир \U0001f600\U0001f468‍\U0001f469", "a" * 500, "0123456789 " * 40, "é" * 50 + " \n" + "ß", "\r\n a\x0b b\x0c c d\u0085e", "tab\t\n x", "é ́x", LONG[:3000],
]


def plain_alignment(texts):
    import sentencepiece
    import tokenizers

    ta = tokenizers.Tokenizer.from_file(A_PATH)
    ta.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    shown = A.byte_alphabet()
    entry = {i: bytes(shown[c] for c in t) for t, i in json.load(open(A_PATH))["model"]["vocab"].items() if t != "<|endoftext|>"}
    out, held = [], Counter()
    for x in texts:
        a, b = (ta.encode(" " + x, add_special_tokens=False).ids, sp.encode(x)) if x else ([], [])
        ba = [entry[i] for i in a]
        bb = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
        raw = (" " + (x or "")).encode()
        if not x or b"".join(ba) != raw or b"".join(bb) != raw:
            out.append((0, 0, 0, [], ""))
            continue

        def ends(parts):
            n = 0
            for p in parts:
                n += len(p)
                yield n

        ea, eb = [*ends(ba)], [*ends(bb)]
        both = sorted({*ea} & {*eb})
        of = lambda e: bisect.bisect_left(both, e)
        groups = [([], []) for _ in both]
        for i, e in zip(a, ea):
            groups[of(e)][0].append(i)
        for i, e in zip(b, eb):
            groups[of(e)][1].append(i)
        links, at = [], 0
        for i, e, p in zip(a, ea, ba):
            for j, f, q in zip(b, eb, bb):
                if f > e - len(p) and f - len(q) < e:
                    links.append((i, j))
        held.update(set(links))
        text = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        out.append((len(a), len(b), len(both), links, hashlib.sha256(text.encode()).hexdigest()))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [(na, nb, ng, len(l), sum(held[x] == most[x[0]] for x in l), sum(held[x] for x in l), h) for na, nb, ng, l, h in out]


@pytest.mark.parametrize("chunk", [A.CHUNK, 200])
def test_alignment_equals_whole_texts(spark, chunk):
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a string").repartition(3)
    rows = A.aligned(frame, A_PATH, B_PATH, groups=True, chunk=chunk).collect()
    want = plain_alignment(TEXTS)
    for r in rows:
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want[r.doc_id], TEXTS[r.doc_id]
        assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 or not r.n_a
    assert len(rows) == len(TEXTS) and sum(w[0] == 0 for w in want) == 4


def test_alignment_of_repeated_null_and_no_rows(spark):
    frame = docs(spark)
    rows = A.op12(frame, A_PATH, B_PATH).collect()
    texts = [r.text for r in frame.select("text").collect()]
    short = [t for t in texts if t is None or len(t) < 10_000]
    assert sorted(r.n_a for r in rows) == sorted(len(x) for t in texts for x in [A.Aligner(A_PATH, B_PATH).a.encode(" " + t, add_special_tokens=False).ids if t and "▁" not in t else []])
    only = frame.where("text is null or length(text) < 10000")
    assert sorted(tuple(r)[1:] for r in A.op12(only, A_PATH, B_PATH).collect()) == sorted(w[:6] + (w[6],) for w in plain_alignment(short))
    assert A.op12(frame.where("false"), A_PATH, B_PATH).count() == 0


def test_memo_halves_give_the_same(spark):
    r = random.Random(4)
    texts = [" ".join("".join(r.choices("abcdeé", k=r.randrange(1, 6))) for _ in range(30)) for _ in range(30)]
    small, large = A.Aligner(A_PATH, B_PATH, memo_bytes=4000), A.Aligner(A_PATH, B_PATH)
    for k in range(0, 30, 5):
        for x, y in zip(small.aligned(texts[k : k + 5]), large.aligned(texts[k : k + 5])):
            assert x[:4] == y[:4] and x[4].tolist() == y[4].tolist()


def test_a_worker_aligns_a_part_once(monkeypatch):
    A.lasting.cache_clear()
    made, aligned = [], A.Aligner._aligned
    monkeypatch.setattr(A.Aligner, "_aligned", lambda self, parts: made.extend(parts) or aligned(self, parts))
    texts = [t for t in TEXTS if t and "\u2581" not in t and max(map(len, A.Aligner.parts(t))) <= A.LONGEST]
    first = [(*x[:4], x[4].tolist()) for x in A.lasting(A_PATH, B_PATH).aligned(texts)]
    n = len(made)
    assert n == len(set(made)) > 20
    assert [(*x[:4], x[4].tolist()) for x in A.lasting(A_PATH, B_PATH).aligned(texts)] == first and len(made) == n
    long = "b" * (A.LONGEST + 1)
    assert [x[:4] for x in A.lasting(A_PATH, B_PATH).aligned([long])] == [x[:4] for x in A.Aligner(A_PATH, B_PATH).aligned([long])] and " " + long not in A.lasting(A_PATH, B_PATH).memo
    A.lasting.cache_clear()


# ---- operator 13


def plain_variants(n, times=10):
    wild, without = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            wild[w[:k], w[k + 1 :]].add(w)
            without[w[:k] + w[k + 1 :]].add(w)
    near = {}
    for w in n:
        x = set(without.get(w, ()))
        for k in range(len(w)):
            x |= wild[w[:k], w[k + 1 :]]
            x |= {w[:k] + w[k + 1 :]} & n.keys()
        near[w] = x - {w}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda y: (-n[y], y))
            if n[best] >= times * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def plain_words(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: k for w, k in count.items() if len(w) >= 7 and k >= 2}


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def test_variants_of_documents(spark):
    r = random.Random(8)
    stems = ["wissenschaft", "überraschung", "señoritas", "languages", "languagess", "École×÷maison", "aaaaaaaa", "ABABABABA"]
    made = []
    for i in range(300):
        words = []
        for _ in range(30):
            w = r.choice(stems)
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abé") + w[k:], w[:k] + r.choice("abÉ") + w[k + 1 :]])
            words.append(w)
        made.append((None if i % 50 == 0 else i // 2, "  ".join(words) + ".", "en", "a", 1))
    from tests.llm.cases import DOCS

    frame = docs(spark, DOCS + made)
    want = plain_variants(plain_words([(d[0], d[1]) for d in DOCS + made]))
    assert rows_of(V.op13(frame)) == want
    assert len(want) > 300 and sum(w[1] is not None for w in want) > 100
    assert V.op13(frame.where("false")).count() == 0


@pytest.mark.parametrize("most", [1, 4, 128])
def test_every_block_size_finds_every_pair_once(spark, most):
    """Words of two letters are near each other all over: blocks are subdivided to the last."""
    r = random.Random(most)
    words = {"".join(r.choices("ab", k=r.choice([7, 8, 8, 9, 10]))) for _ in range(400)} | {"a" * k for k in range(7, 16)} | {"é" * 40, "é" * 41, "é" * 20 + "b" + "é" * 20}
    n = {w: r.choice([2, 3, 30, 400, 5000]) for w in words}
    known = spark.createDataFrame([*n.items()], "word string, n long")
    assert rows_of(V.variants(known, most=most)) == plain_variants(n)


def test_forms_lead_to_roots(spark):
    n = {"abcdefg": 10**6, "abcdefgh": 10**5, "abcdefghi": 10**4, "abcdefghij": 10**3, "abcdefghijk": 10, "zzzzzzz": 5}
    got = {r.word: r for r in V.variants(spark.createDataFrame([*n.items()], "word string, n long")).collect()}
    assert got["abcdefghijk"].root == "abcdefg" and got["abcdefghijk"].form == "abcdefghij" and got["abcdefg"].form is None
    assert got["zzzzzzz"].root == "zzzzzzz" and got["zzzzzzz"].n_near == 0


def test_blocks_hold_what_the_bound_says(spark):
    known = spark.createDataFrame([("".join(p), 2) for k in range(2000) for p in [f"{k:011b}".replace("0", "x").replace("1", "y")]], "word string, n long")
    sizes = V.blocks(known, V.SHORTEST, 16).groupBy(*V.PLACE).count().select("m", "i", "j", "count").collect()
    assert all(r["count"] <= 16 or r.m - r.i - r.j < 2 for r in sizes)


# ---- earlier operators


def test_a_document_of_several_texts_is_one_node(spark):
    from recordmill.llm.simhash import op4

    a, b, c = ("alpha beta gamma delta one two", "one other text that is far from it and longer", "a third text without anything of the two before")
    rows = [(3, a), (5, a), (5, b), (9, b), (11, c), (None, a), (12, c), (12, None), (13, "")]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in op4(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (3, 3), (5, 3), (5, 3), (9, 3), (11, 11), (12, 11), (12, 11), (13, 11)]


def test_pseudo_likelihood_is_the_same_however_rows_are_dealt(spark):
    from recordmill.llm import pseudolm

    r = random.Random(3)
    words = ["w" + str(i) for i in range(60)]
    rows = [(i, " ".join(r.choices(words, k=r.randrange(0, 80)))) for i in range(300)] + [(None, "w1 w2 w3"), (7, None), (7, "w1 w2 w3")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    nets = []
    for n in (1, 3, 7):
        dealt = frame.repartition(n).orderBy(F.rand(n)) if n > 1 else frame.coalesce(1)
        vocab = pseudolm.vocabulary(dealt)
        nets.append(pseudolm.trained(pseudolm.tokenised(dealt, vocab.common), shards=5).packed())
    assert nets[0] == nets[1] == nets[2]


def test_language_sample_holds_a_repeated_row_once(spark, monkeypatch):
    from recordmill.llm import langid

    seen = []
    monkeypatch.setattr(langid.ByteGru, "fit", lambda self, windows, labels: seen.append((self.langs, labels.tolist())))
    rows = [(1, "the same words again and again", "en")] * 5000 + [(100 + i, f"le petit chat {i} ici", "fr") for i in range(60)]
    langid.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=16)
    (langs, labels), = seen
    assert langs == ["en", "fr"] and labels.count(0) == 1 and 10 <= labels.count(1) <= 16


def test_words_are_hashed_at_once_as_python_splits_them():
    import numpy as np

    from recordmill.llm import pseudolm

    r = random.Random(5)
    alphabet = "abZ \u03a3\u03c3\u0130\n\t\x1c\x1f\x85\xa0\u1680\u2003\u2028\u200b\u3000\ufeff\u00e9\u4e2d\U0001f600\x00"
    texts = ["".join(r.choices(alphabet, k=r.randrange(40))) for _ in range(500)] + ["", "x" * (2 * pseudolm.RUN) + " y z" * pseudolm.RUN, "y"]
    words = [t.lower().split() for t in texts]
    hashes, sizes = pseudolm.words_of(texts)
    assert sizes.tolist() == [len(w) for w in words]
    flat = [x for w in words for x in w]
    by_word = dict(zip(flat, hashes.tolist(), strict=True))
    assert [by_word[x] for x in flat] == hashes.tolist() == pseudolm.hashes_of(flat).tolist()  # wherever a word stands
    assert len(set(by_word.values())) == len(by_word)
    close = [f"{a}{b}{i}" for a in "abc" for b in ("", "\x00", "a") for i in range(20000)]
    assert len(np.unique(pseudolm.hashes_of(close))) == len(set(close))
    assert pseudolm.hashes_of([]).tolist() == [] and [x.tolist() for x in pseudolm.words_of([])] == [[], []]


def test_each_shard_is_a_partition_of_its_own(spark):
    from recordmill.llm import pseudolm

    tokens = spark.createDataFrame([(i * 7919, b"\x01\x00", i) for i in range(400)], "seed long, ids binary, id long")
    got = pseudolm.dealt(tokens, 16).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.countDistinct("shard").alias("n")).collect()
    assert len(got) == 16 and {r.n for r in got} == {1}
