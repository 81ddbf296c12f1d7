"""Operators against brute force on the smallest tables, SQL, and an exact round trip."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from sparquill.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(sf_dir):
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()}


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def components(texts, size, threshold):
    """Sets, and the smallest id that each document reaches, by counting shared grams of all pairs."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lowered(t))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for g in sets[i] for j in holders[g])
        for g in sets[i]:
            holders[g].append(i)
        for j, n in shared.items():
            if 100 * n >= threshold * (len(sets[i]) + len(sets[j]) - n):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return sets, {i: top(i) for i in sets}


def test_jaccard(spark, sf_dir, texts):
    sets, want = components(texts, 4, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op1_ngram_jaccard(spark, sf_dir).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in texts}


def test_jaccard_with_frequent_grams(spark, monkeypatch):
    """Combinations: with a low limit nearly all grams of a group are frequent."""
    import random

    from sparquill.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
    monkeypatch.setattr(jaccard_join, "VERY", 6)
    monkeypatch.setattr(jaccard_join, "PAIRED", 4)
    r = random.Random(3)
    rows = {}
    for g in range(12):
        words = [f"w{r.randrange(400)}" for _ in range(r.choice([6, 9, 20, 60, 200]))]
        for k in range(25):
            own = list(words)
            for _ in range(r.randrange(0, 1 + len(own) // 25)):
                own[r.randrange(len(own))] = f"x{r.randrange(50)}"
            rows[g * 100 + k] = " ".join(own)
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for size, threshold in ((2, 80), (1, 60)):
        _, want = components(rows, size, threshold)
        got = {x["doc_id"]: x["component_id"] for x in jaccard_join.jaccard_components(table, size, threshold).collect()}
        assert got == want


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLE_SQL[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    rows = lambda cols, found: sorted((tuple(r[cols.index(c)] for c in order) for r in found), key=repr)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_secrets(spark, sf_dir, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {r["doc_id"]: r for r in queries.op3_secret_scan(spark, sf_dir).collect()}
    for i, t in texts.items():
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert got[i]["base_sha256"] == sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)))


def test_trigram_queries():
    from sparquill.llm.secret_scan import trigram_query

    assert trigram_query("abcd") == [frozenset({"abc", "bcd"})]
    assert trigram_query("(abc|xyz1)+[0-9]*end") == [frozenset({"abc", "end"}), frozenset({"xyz", "yz1", "end"})]
    assert trigram_query("ab?cd") == [frozenset({"acd"}), frozenset({"abc", "bcd"})]
    assert trigram_query("[0-9]+") is None and trigram_query("abc|[0-9]+") is None


def test_pages(spark, sf_dir):
    """Held out: no page of the table is among those that the labeller is fitted to."""
    import html

    got = {r["page_id"]: r["text"] for r in queries.op4_html_extract(spark, sf_dir).collect()}
    good = n = 0
    for i, page in duckdb.sql(f"SELECT page_id, html FROM '{sf_dir}/pages.parquet'").fetchall():
        body = re.search("<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", body))
        good += got[i] == "\n".join(x for x in parts if x)
        n += 1
    assert good >= 0.98 * n


def test_labeller_on_new_layouts():
    from sparquill.llm import html_extract
    from sparquill.llm.block_labeller import Path, features, scores

    fitted = html_extract.labeller()
    right = n = 0
    for seed in range(100_000, 100_060):
        page, own = html_extract.made_up(seed)
        found = html_extract.blocks(page, Path(known=fitted["names"]))
        p = scores(features([found]), fitted)[0]
        right += sum((x >= 0.5) == (b.text in own) for x, b in zip(p, found, strict=True))
        n += len(found)
    assert right >= 0.95 * n


def test_gradients():
    """The backward pass against differences, and a fit to what the features tell."""
    import numpy as np

    from sparquill.llm import block_labeller as L

    r = np.random.default_rng(0)
    root = L.Path()
    chains = [root.child(("div", f".{x}")).child(("p",)) for x in "abcd"]
    pages = [L.Features([chains[k] for k in r.integers(0, 4, n)], r.standard_normal((n, L.WORD + L.MEASURES)).astype(np.float32)) for n in (5, 2, 9, 1)]
    labels = [(p.small[:, 0] + np.array([x is chains[0] for x in p.paths]) > 0.5).astype(np.float32) for p in pages]
    weights, y = {k: w.astype(np.float64) for k, w in L.initial().items()}, np.concatenate(labels)

    def loss(w):
        p = L._probable(L._Batch(pages).states(w), w)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    batch, kept = L._Batch(pages), []
    states = batch.states(weights, kept)
    back = (L._probable(states, weights) - y)[:, None] / len(y) @ weights["V"].T
    grads = batch.back(weights, kept, np.stack([back[:, : L.HIDDEN], back[:, L.HIDDEN :]]))
    for name, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        step = np.zeros_like(weights[name])
        step[at] = 1e-2
        near = (loss(weights | {name: weights[name] + step}) - loss(weights | {name: weights[name] - step})) / 2e-2
        assert abs(near - g[at]) <= 0.02 * abs(g[at]) + 1e-5, name
    fitted = L.train(pages * 20, labels * 20, epochs=30)
    for p, y in zip(L.scores(pages, fitted), labels, strict=True):
        assert ((p >= 0.5) == y).all()


@pytest.mark.parametrize("piece", ["<a ", "<svg>", "<!", '"', "<a b='", "<select>", "</b>", "<b>", "<div>x", '<a b="" ', "<!--", "<script>x</scrip", "<p>x<hr>", "&#x", "<a b=\">\" c"])
def test_parser_is_linear(piece):
    import time

    from sparquill.llm.html_extract import blocks

    page = "<p>first</p>" + piece * (1_000_000 // len(piece))
    began = time.process_time()
    found = blocks(page)
    assert found[0].text == "first" and time.process_time() - began < (8 if "x" in piece else 3)


def test_parser():
    from sparquill.llm.html_extract import blocks

    def chain(path):
        return (*chain(path.up), *path.tokens) if path.up else ()

    texts = lambda page: [b.text for b in blocks(page)]
    assert texts('<p>a<svg class="icon"/> b<p>c<svg><text>no</text></svg> d') == ["a b", "c d"]
    assert texts("<p class=don't>one</p><p title=it's>two</p><p x=\"a>b\">three</p>") == ["one", "two", "three"]
    assert texts("<p>a<script>if (a < b) '</p>'</script>b</p><style>p{}</style ><p>c") == ["ab", "c"]
    assert texts("<p>x &lt;b&gt; &amp;&nbsp;y &copy;</p><!-- <p>no</p> --><p>z") == ["x <b> & y ©", "z"]
    assert texts("<p>a<a href=http://x/y/>link</a> b</p>") == ["alink b"]
    deep = "<article class='a b c d e f g h i comments'>" + "<div>" * 40 + "<p>text"
    assert {"article", ".comments"} <= set(chain(blocks(deep)[0].path))


LAYOUTS = {
    "no article element": (
        '<html><body><div id="header"><div class="logo">The Daily</div><ul class="menu"><li><a href="/">Home</a></li><li><a href="/w">World</a></li></ul></div><div class="cookie-notice">We use cookies. <button>OK</button></div>'
        '<div id="main"><div class="row"><div class="col"><div class="post-content"><h1>How rivers change their beds</h1><p>Rivers move. Over the years, a bend grows wider, and water finds a shorter way.</p><p>Short one.</p>'
        "<ul><li>First, the outer bank wears off.</li><li>Then the neck is cut.</li></ul><p>What is left is a lake in the form of a bow, which slowly fills with mud &amp; reeds.</p></div></div></div></div>"
        '<div id="sidebar"><h3>Popular</h3><ul><li><a href="/1">Ten lakes to see</a></li></ul></div><div id="footer">&copy; 2020 The Daily. All rights reserved.</div></body></html>',
        "How rivers change their beds\nRivers move. Over the years, a bend grows wider, and water finds a shorter way.\nShort one.\nFirst, the outer bank wears off.\nThen the neck is cut.\nWhat is left is a lake in the form of a bow, which slowly fills with mud & reeds.",
    ),
    "table": (
        '<html><body><table><tr><td><ul class="nav"><li><a href="/a">Start</a></li><li><a href="/b">About us</a></li></ul></td><td><div class="content"><h1>Boiling points</h1><p>Liquids boil at temperatures that depend on pressure, as everybody in the mountains knows.</p>'
        "<table><tr><th>Liquid</th><th>Point</th></tr><tr><td>Water</td><td>100 degrees</td></tr></table><p>At half the pressure of the sea's level, water boils at about 81 degrees.</p></div></td><td><div class=\"ads\">Buy kettles now!</div></td></tr></table></body></html>",
        "Boiling points\nLiquids boil at temperatures that depend on pressure, as everybody in the mountains knows.\nLiquid\nPoint\nWater\n100 degrees\nAt half the pressure of the sea's level, water boils at about 81 degrees.",
    ),
    "comments inside the article": (
        '<html><body><nav><a href="/">Home</a> <a href="/blog">Blog</a></nav><article class="post"><h1>A week without a phone</h1><p>On Monday I left it in a drawer, and the first hours were long.</p><p>By Friday, I had read two books.</p>'
        '<section class="comments"><h3>3 replies</h3><div class="comment"><b>Ann</b><p>I tried the same last year, and lasted for a day and a half, honestly. It was hard.</p></div><div class="comment"><b>Bob</b><p>Nice text, thank you for writing it down!</p></div></section></article><footer>Imprint</footer></body></html>',
        "A week without a phone\nOn Monday I left it in a drawer, and the first hours were long.\nBy Friday, I had read two books.",
    ),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(spark, name):
    """Held-out layouts, with their exact text."""
    from sparquill.llm import html_extract

    page, want = LAYOUTS[name]
    assert html_extract.main_text(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()["text"] == want


def test_benchmark(spark, sf_dir, texts):
    """Documents that hold most of an item's words in a row are found, no others."""
    items = dict(duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall())
    grams = lambda t: {tuple(w[k : k + 6]) for w in [re.findall(r"\w+", t.lower())] for k in range(len(w) - 5)}
    own = {i: grams(t) for i, t in items.items()}
    want = {(d, i) for d, t in texts.items() for g in [grams(t)] for i in items if len(g & own[i]) >= 0.5 * len(own[i])}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op5_decontaminate(spark, sf_dir).collect()}
    assert got == want


def test_packing(spark, sf_dir, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op8_packing(spark, sf_dir).collect():
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in texts.items():
        ids, at = [*tokenizer.encode(t, add_special_tokens=False).ids, 1], 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            own = ids[at : at + r["length"]]
            assert r["start"] == at and len(own) == r["length"] and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            at += len(own)
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


@pytest.mark.parametrize("text", ["", " ", "a  b", "a\n\nb c", "a b\n", " a b", "a\tb c", "it's  x'll 12ab", "é ü x y", "x  y", "<|endoftext|> a", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", "a <|endoftext|  > b"])
def test_encoder(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    from sparquill.llm.packing import encoder

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder(queries.ranks(), queries.control())(text) == tokenizer.encode(text, add_special_tokens=False).ids
    tokenizer.encode_special_tokens = True
    assert encoder(queries.ranks())(text) == tokenizer.encode(text, add_special_tokens=False).ids


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        luhn = sum(d - 9 * (d > 9) for k, c in enumerate(reversed(digits)) for d in [int(c) * (1 + k % 2)])
        return 13 <= len(digits) <= 19 and luhn % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def test_personal_data(spark, sf_dir, texts, tmp_path):
    odd = ["a@b.c_d@e.f x@@y.z @ a@b", "1.2.3.4.5.6.7.8 001.002.003.0004 1.2.3.256 9.9.9", "4111-1111 1111-1111 4111111111111112 1 2", "+1 (555) 123-4567) +12 +123456789012345678 +1..2 é+44 20 7946 0958", "a" * 5000 + "@x", "9" * 5000, "a@b" + ".c" * 5000, "é a@b.cc " * 300]
    rows = texts | {-1 - k: t for k, t in enumerate(odd)}
    spark.createDataFrame(list(rows.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op10_pii(spark, str(tmp_path)).collect()}
    for i, t in rows.items():
        spans = {k: [(m.start(), m.end()) for m in re.finditer(p, t) if holds(k, m[0])] for k, p in PATTERNS.items()}
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [len(s) for s in spans.values()], i
        assert got[i]["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in spans[k])), i


def test_pipeline(spark, sf_dir, texts):
    """The stages by hand: kept by SQL's verdict, first of each component, without items, masked, packed."""
    import corpus_pipeline

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    verdict = con.sql(queries.ORACLE_SQL["op9_quality_rules"])
    at = verdict.columns.index("kept"), verdict.columns.index("doc_id")
    kept = {r[at[1]]: texts[r[at[1]]] for r in verdict.fetchall() if r[at[0]]}
    _, first = components(kept, 5, 80)
    kept = {i: t for i, t in kept.items() if first[i] == i}
    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{sf_dir}/benchmark.parquet'").fetchall()]
    kept = {i: t for i, t in kept.items() if not any(x in t for x in items)}
    tokens = defaultdict(int)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        tokens[r["doc_id"]] += r["length"]
    assert set(tokens) <= set(kept) and len(set(kept) - set(tokens)) <= 2  # partial passages of items


def test_similar_pairs(spark):
    """All links between different sets, by brute force, also where nearly all grams are frequent."""
    import random

    from sparquill.llm import jaccard_join

    r, rows = random.Random(8), {}
    for g in range(10):
        words = [f"w{r.randrange(300)}" for _ in range(r.choice([5, 12, 40, 150]))]
        for k in range(12):
            own = list(words)
            for _ in range(r.randrange(0, 1 + len(own) // 12)):
                own[r.randrange(len(own))] = f"x{r.randrange(40)}"
            rows[g * 100 + k] = " ".join(own[: len(own) - r.randrange(0, 1 + len(own) // 10)])
    rows |= {5000: rows[0], 5001: "", 5002: "single"}
    sets, _ = components(rows, 3, 70)
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    pairs, members = jaccard_join.similar_pairs(table, 3, 70)
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    assert {x["doc_id"]: x["first"] for x in members.collect()} == {i: first[frozenset(s)] for i, s in sets.items() if s}
    names = sorted(set(first.values()) - {5001})
    want = {(a, b, len(sets[a]), len(sets[b]), len(sets[a] & sets[b])) for a in names for b in names if a < b and 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b])}
    got = [tuple(x[c] for c in ("a", "b", "n_a", "n_b", "shared")) for x in pairs.collect()]
    assert len(want) > 100 and sorted(got) == sorted(want)


def test_jaccard_template_is_not_paired(spark, monkeypatch):
    """Documents of one template below the threshold share buckets, but none of their pairs is even looked at."""
    from sparquill.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "VERY", 20)
    seen, pairs = [], jaccard_join._by_size
    monkeypatch.setattr(jaccard_join, "_by_size", lambda *a: seen.append(pairs(*a)) or seen[-1])
    rows = [(i, " ".join(f"o{i}x{k}" if k in (20, 50, 80) else f"t{k}" for k in range(100))) for i in range(600)]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert found.select("component_id").distinct().count() == 600 and seen[0].count() == 0


def test_jaccard_writes_little(spark, monkeypatch):
    """Copies have no signatures, long texts that share a passage aren't compared wholly, and shuffles go with their queries."""
    import random

    from sparquill.llm import common, jaccard_join

    r = random.Random(5)
    some = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, passage = {}, some(60)
    for g in range(8):  # long, and below the threshold but for a copy each that lacks some words
        words = [*some(900), *passage, *some(1000)]
        rows |= {g: " ".join(words), 100 + g: " ".join(words[:-30])}
    for k, n in enumerate((1026, 259, 513)):  # near copies whose finer sketches differ in size, or of which one has none
        words = some(n + 6)
        rows |= {200 + k: " ".join(words[:n]), 300 + k: " ".join(words)}
    rows |= {1000 + i: rows[i % 3] for i in range(60)}
    written, settle, key = [], common.settle, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def seen(df, path):
        out = settle(df, path)
        written.append((path.rsplit("/", 1)[1], out, spark.conf.get(key, None), [(x["a"], x["b"]) for x in out.collect()] if out.columns == ["a", "b", "n_a", "n_b"] else [], out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "settle", seen)
    monkeypatch.setattr(jaccard_join, "SLICE", 1 << 10, raising=False)
    _, want = components(rows, 5, 80)
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    found = jaccard_join.jaccard_components(table, 5, 80)
    assert {x["doc_id"]: x["component_id"] for x in found.collect()} == want and len(set(want.values())) == 11
    ((signed, n),) = [(out, n) for name, out, *_, n in written if name == "signed"]
    assert n == len(set(rows.values())) == 22 and len(signed.columns) > 2
    pairs = [p for *_, ps, _ in written for p in ps]
    assert len(pairs) >= 11 and all(want[a] == want[b] for a, b in pairs)
    assert {on for _, _, on, *_ in written} == {"true"} and spark.conf.get(key, None) is None


ALNUM = re.compile("[A-Za-z0-9\u0080-\U0010ffff]+")


def cut_sentences(text, window=11):
    """Words (lowered), their first places, and where sentences begin, by the rules in plain words."""
    from sparquill.llm.common import hash_of

    found = [(lowered(m[0]), m.start(), m.end()) for m in ALNUM.finditer(text)]
    heads = [k for k in range(len(found)) if not k or re.search("[.!?\n]", text[found[k - 1][2] : found[k][1]])]
    keys = [hash_of(w) & ~63 for w, _, _ in found]
    cuts = set(heads)
    for a, b in zip(heads, [*heads[1:], len(found)], strict=True):
        for k in range(a, b - window + 1):
            cuts.add(max(range(k, k + window), key=lambda j: (-keys[j], j)))
    return [w for w, _, _ in found], [x for _, x, _ in found], sorted(cuts)


def test_substring_brute_force(spark, sf_dir, texts):
    """Every span of sentences of the smallest table by hand: what is removed, and what is left."""
    cut = {i: cut_sentences(t) for i, t in texts.items()}
    first, own = {}, defaultdict(list)
    for i in sorted(cut):
        words, _, heads = cut[i]
        ends = [*heads[1:], len(words)]
        for k, a in enumerate(heads):
            last = next((j for j in range(k + 1, len(heads)) if ends[j] - a >= 20), None)
            if last is not None:
                key = tuple(words[a : ends[last]])
                first.setdefault(key, (i, k))
                own[i].append((key, k, last))
    want = {}
    for i, spans in own.items():
        again = [(first[key], k, last) for key, k, last in spans if first[key] != (i, k)]
        if again:
            words, starts, heads = cut[i]
            gone = {j for _, k, last in again for j in range(k, last + 1)}
            ends, edges = [*heads[1:], len(words)], [*(starts[h] for h in heads), len(texts[i])]
            left = texts[i][: edges[0]] + "".join(texts[i][edges[j] : edges[j + 1]] for j in range(len(heads)) if j not in gone)
            want[i] = (min(p[0] for p, _, _ in again), len(heads), len(gone), sum(ends[j] - heads[j] for j in gone), left)
    got = {r["doc_id"]: (r["first_doc_id"], r["n_sentences"], r["n_removed"], r["removed_words"], r["text"]) for r in queries.op6_substring_dedup(spark, sf_dir).collect()}
    assert want and got == want


def test_substring_recall(spark):
    """Documents of sf0.01 that repeat 51 words in a row of an earlier one lose words, and hardly any others do."""
    d = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{d}/documents.parquet' ORDER BY doc_id").fetchall()

    def runs(text, n):
        w = [lowered(x) for x in ALNUM.findall(text)]
        return [hash(tuple(w[k : k + n])) for k in range(len(w) - n + 1)]

    repeats = {}
    for n in (20, 51):
        seen, repeats[n] = set(), set()
        for i, t in rows:
            own = runs(t, n)
            if any(x in seen for x in own) or len(set(own)) < len(own):
                repeats[n].add(i)
            seen.update(own)
    got = {r["doc_id"] for r in queries.op6_substring_dedup(spark, d).select("doc_id").collect()}
    assert repeats[51] and repeats[51] <= got <= repeats[20]


def test_disclosing_terms_brute_force(spark, sf_dir, texts, tmp_path):
    """Terms of the smallest table and of planted texts by hand, and where they stand."""
    import math

    import regex

    rows = dict(texts)
    for k in range(5):
        rows[9000 + k] = f"Dear Quixada, item {k}. Write to box@mail.example.org or Quixada-Hall {k}"
        rows[9100 + k] = f"Zorbanel keeps +44 20 7946 0958 and 4111 1111 1111 1111, number {k}"
    rows |= {9200: "Zorbanel and quixada again, zorbanels not", 9201: rows[9000], 9202: "QUIXADA", 9203: ""}
    spark.createDataFrame(list(rows.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    term = regex.compile(r"(?<![\p{L}\p{N}])\p{L}[\p{L}'\u2019-]*+\p{L}?(?![\p{L}\p{N}])")
    terms = lambda t: {m[0] for m in term.finditer(t.lower())}
    spoken = lambda k, m: m.lower() if k == "email" else m if k == "ip" else re.sub(r"[\x20().-]", "", m)
    different = set(rows.values())
    df_term, df_entity, c = Counter(), Counter(), Counter()
    for t in different:
        df_term.update(terms(t))
        found = {(k, m[0]) for k, p in PATTERNS.items() for m in re.finditer(p, t) if holds(k, m[0])}
        entities = {(k, spoken(k, m)) for k, m in found}
        df_entity.update(entities)
        if entities:
            near = terms(regex.sub("|".join(regex.escape(m) for m in sorted({m for _, m in found}, reverse=True)), " ", t))
            c.update((w, e) for w in near for e in entities)
    strong = {w for (w, e), n in c.items() if n >= 3 and n >= 0.5 * df_term[w] and math.log2(n * len(different) / (df_term[w] * df_entity[e])) >= 4}
    assert {"quixada", "zorbanel"} <= strong
    got = {r["doc_id"]: r["spans"] for r in queries.op10_pii(spark, str(tmp_path)).collect()}
    for i, t in rows.items():
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t) if holds(k, m[0])]
        own = sorted(strong & terms(t))
        if own:
            any_of = regex.compile(r"(?<![\p{L}\p{N}])(?i:" + "|".join(map(regex.escape, own)) + r")(?![\p{L}\p{N}])")
            spans += [f"term:{m.start()}:{m.end()}" for m in any_of.finditer(t)]
        assert got[i] == ",".join(spans), i
