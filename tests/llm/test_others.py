"""Vectors, pages and the pipeline."""

import numpy as np

import corpus_pipeline
from recordmill.llm import html, lattice
from tests.llm.cases import DOCS, docs


def test_lattice_points():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8))
    p = lattice.decode(x)
    assert len(lattice.ROOTS) == 240 and ((lattice.ROOTS**2).sum(axis=1) == 2).all()
    d = ((x - p) ** 2).sum(axis=1)
    assert (d[:, None] <= ((x[:, None] - p[:, None] - lattice.ROOTS) ** 2).sum(axis=2) + 1e-12).all()  # no neighbour is nearer
    assert d.max() <= 1 + 1e-9  # the covering radius


def vectors():
    rng, rows = np.random.default_rng(1), []
    for b in rng.normal(size=(150, 64)):
        b /= np.linalg.norm(b)
        rows.append(b)
        for _ in range(rng.integers(0, 3)):
            c, u = rng.uniform(0.85, 1), rng.normal(size=64)
            u -= u @ b * b
            rows.append((c * b + np.sqrt(1 - c * c) * u / np.linalg.norm(u)) * rng.uniform(0.5, 2))
    rows += [rows[0] + 0.03 * rng.normal(size=64) for _ in range(60)] + [rows[5]] * 20
    out = [[float(np.float32(y)) for y in r] for r in rows]
    return out + [None, [], [0.0] * 64, [1.0, None] + [0.0] * 62, [float("nan")] * 64, [1.0, 2.0], [2.0, 4.0]]


def test_lattice_recall_and_links(spark):
    vs = vectors()
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vs)], "vec_id long, embedding array<float>, n_links int")
    n, x, ok = len(vs), np.zeros((len(vs), 64)), np.zeros(len(vs), bool)
    for i, v in enumerate(vs):
        if v and None not in v and np.isfinite(v).all() and any(v):
            x[i, : len(v)], ok[i] = np.array(v) / np.linalg.norm(v), True
    same = np.array([len(v or []) for v in vs])
    link = (x @ x.T >= 0.9) & ok[:, None] & ok[None] & (same[:, None] == same[None])
    np.fill_diagonal(link, False)
    for tile in (1024, 16):
        got = sorted(lattice.near_vectors(df, tile=tile).collect())
        links = np.array([r.n_links for r in got])
        assert [r.vec_id for r in got] == list(range(n)) and (links <= link.sum(axis=1)).all() and links.sum() >= 0.95 * link.sum()
        assert all(r.kept == (r.vec_id == r.component_id) for r in got) and all(r.n_links == 0 and r.kept for r in got if not ok[r.vec_id])
        assert got[n - 1].component_id == n - 2
    assert lattice.op5(df.limit(0)).count() == 0


def test_vectors_without_or_with_the_same_number(spark, tmp_path):
    import duckdb

    from recordmill.llm.queries import OP5_SQL

    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(None, a), (4, a), (4, [2.0, 0.0, 0.0]), (7, b), (None, c), (None, None), (9, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, component_id string, kept int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.op5(df).collect()), key=str)
    df.select("vec_id", "embedding").coalesce(1).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    assert sorted(con.sql(OP5_SQL).fetchall(), key=str) == got
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (7, 0, 7, True), (None, 0, None, False), (None, 0, None, False), (9, 0, 9, True)], key=str)


def test_forests_join_what_links_join():
    from recordmill.llm.forest import spanning

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 300, 260), rng.integers(0, 300, 260)
    x, y = spanning(np.arange(300), a, b)

    def classes(a, b):
        comp = list(range(300))
        for _ in range(300):
            for u, v in zip(a.tolist(), b.tolist()):
                comp[u] = comp[v] = min(comp[u], comp[v])
        return comp

    assert classes(a, b) == classes(x, y) and len(x) == 300 - len(set(classes(a, b)))


def test_blocks_of_awkward_pages():
    cut = lambda p: [t for _, t, _ in html.blocks_of(p)]
    assert cut("") == [] and cut("<!-- open <p>x") == [] and cut("<script>var a='</p>'; <p>x") == []
    assert cut("<p>a &amp; b&nbsp;c<p><b>d<br>\n e</p>f") == ["a & b c", "d e", "f"]
    assert cut('<div title="a>b">x</div></p></nav>y') == ["x", "y"]
    assert cut("plain & text") == ["plain & text"]


def test_hostile_pages_take_seconds():
    import time

    start = time.time()
    for page in ('<a href="x>' + "y" * 1_000_000, '<a "' * 250_000, "<a '>'" * 150_000 + '"', "<div>" * 200_000 + "x", "<div><p>a" * 60_000 + "</div>" * 60_000, "<!-- " * 100_000, "<script>" * 100_000, "</b>" * 250_000, "< <" * 300_000):
        html.blocks_of(page)
    assert time.time() - start < 30
    n = 30_000
    assert html.main_texts(html.BlockLstm(), ["<p>word</p>" * n + "<i <b>end"])[0].count("\n") < n
    assert [t for _, t, _ in html.blocks_of("<p title='a>b<c'>x<i y<b z>w")] == ["xw"]


def plain_lstm(net, x):
    """Log odds of each block, one block and one gate at a time."""
    h, score = net.h, x @ net.p["s"][:, 0] + net.p["o"][0]
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    for d in "fb":
        state, cell = np.zeros(h), np.zeros(h)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            i, f, o, c = (x[t] @ net.p[f"x{d}"][:, k * h : (k + 1) * h] + net.p[f"b{d}"][k * h : (k + 1) * h] + state @ net.p[f"u{d}"][:, k * h : (k + 1) * h] for k in range(4))
            cell = sigmoid(f) * cell + sigmoid(i) * np.tanh(c)
            state = sigmoid(o) * np.tanh(cell)
            score[t] += state @ net.p[f"v{d}"][:, 0]
    return score


def test_block_network_equals_a_plain_pass_and_differences():
    rng, net = np.random.default_rng(6), html.BlockLstm(hidden=4)
    net.p = {k: v.astype(np.float64) + 0.05 * rng.normal(size=v.shape) for k, v in net.p.items()}
    pages = [rng.normal(size=(n, html.DIM)) for n in (7, 3)]
    x, mask = html._padded(pages)
    got = net.scores(net.drives(x), mask)
    for k, page in enumerate(pages):
        assert np.abs(got[k, : len(page)] - plain_lstm(net, page)).max() < 1e-9
    labels = rng.integers(0, 2, mask.shape).astype(np.float64)
    loss = lambda: (np.logaddexp(0, s := net.scores(net.drives(x), mask)) - labels * s)[mask].mean()
    for name, g in net.gradients(x, mask, labels).items():
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        net.p[name][at] += 1e-5
        up = loss()
        net.p[name][at] -= 2e-5
        down = loss()
        net.p[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6, name


def test_block_labels():
    model, rng, hits, n = html.trained(), np.random.default_rng(99), 0, 0
    for _ in range(60):
        page, labels = html.laid_out(rng)
        x, mask = html._padded([html.features(html.blocks_of(page))])
        hits += int(((model.scores(model.drives(x), mask)[0] > 0) == np.array(labels)).sum())
        n += len(labels)
    assert hits / n > 0.99


def test_pages(spark):
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><div class=\"ad\">Buy</div><article><h1>Head</h1><p>One  two.</p><p>Three</p></article><footer>&copy; x</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page, "c"), (2, None, None, "c"), (3, "v", "", "c"), (1, "u", page, "c")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.op6(df).collect())
    assert got == [(1, "Head\nOne two.\nThree", 19), (1, "Head\nOne two.\nThree", 19), (2, "", 0), (3, "", 0)]
    assert html.op6(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    """Each stage on the rows that its predecessor kept, against what it must do to them."""
    now, seen = docs(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stage(spark, now, "")
        rows = now.collect()
        now = spark.createDataFrame(rows, now.schema)
        seen[name] = rows
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == before.columns
    ids = lambda k: [r.doc_id for r in seen[k]]
    assert {2, 3, 4, 7}.isdisjoint(ids("language ID")) and len(ids("language ID")) == len(DOCS) - 4
    assert ids("SimHash near-dedup").count(5) == 1 and not {8} & set(ids("SimHash near-dedup")) and {1, 6, 9, 10} <= set(ids("SimHash near-dedup"))
    assert set(ids("secret scans")) == set(ids("SimHash near-dedup")) and not any("0123456789abcdef" in (r.text or "") for r in seen["secret scans"])
    assert set(ids("source mixing")) <= set(ids("secret scans"))
    last = seen["SentencePiece encoding"]
    assert len(last) == len(seen["source mixing"]) and all(r.n_tokens == len(r.token_ids) for r in last)
    empty = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0
