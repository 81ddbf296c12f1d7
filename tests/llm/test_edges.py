"""Nulls, empty texts, ties, repeated rows, empty tables and clashing columns for each operator."""

import pytest
from pyspark.sql import functions as F

from sparquill.llm import chat_format, decontaminate, html_extract, jaccard_join, packing, pii, quality_rules, secret_scan, substring_dedup, warc
from sparquill.llm.common import shared_dir
from sparquill.llm.queries import ranks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(400))


def docs(spark, rows):
    """Documents with extra columns that clash with names used within operators."""
    table = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
    for name in ("doc", "hash", "t", "sig", "clean", "spans", "component_id", "host", "slot"):
        table = table.withColumn(name, F.lit("clash"))
    return table


ROWS = [(1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (3, None, None), (4, "", "a"), (5, " \n\t ", "a"), (None, LONG, "a"), (6, "one two", "b"), (6, "three four five six seven", "b"), (7, "one two", "b")]


@pytest.fixture(scope="module")
def mixed(spark):
    return docs(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, ROWS).where("doc_id = -1")


def found(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_jaccard(mixed, none):
    got = found(jaccard_join.jaccard_components(mixed, 4, 85), "doc_id", "n_shingles", "component_id")
    assert got == sorted([(1, 397, 1), (2, 397, 1), (2, 397, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (None, 397, None), (6, 1, 6), (6, 2, 6), (7, 1, 6)], key=repr)
    assert jaccard_join.jaccard_components(none).count() == 0
    kept = found(jaccard_join.one_of_each(mixed), "doc_id")
    assert kept == sorted([(1,), (3,), (4,), (5,), (6,), (None,)], key=repr)
    with pytest.raises(ValueError):
        jaccard_join.jaccard_components(mixed, 4, 20)


def test_warc(spark):
    page = "<p>" + "x" * 200
    rows = [(2, "http://a/\r\nX: y", page, 0), (1, None, page, 0), (1, "u", page, 0), (3, "u", None, 0), (4, "u", "tiny", 0), (5, "u", "tiny", 0), (None, "u", page, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    base = shared_dir(spark)
    files = warc.write_warc(pages, f"{base}/w")
    got = found(warc.read_warc(spark, files, 100), "page_id", "record_type", "uri", "refers_to")
    assert got == sorted([(2, "revisit", "http://a/\r\nX: y", 1), (1, "response", None, None), (1, "response", "u", None), (3, "response", "u", None), (4, "response", "u", None), (5, "response", "u", None), (None, "response", "u", None)], key=repr)
    read = warc.digests(warc.read_warc(spark, files), f"{base}/r")
    assert (2, 203) in found(read, "page_id", "payload_bytes") and read.count() == 7
    empty = warc.write_warc(pages.where("page_id = -1"), f"{base}/e")
    assert empty == [] and warc.read_warc(spark, empty).count() == 0


def test_secrets(spark, mixed, none):
    assert found(secret_scan.find_secrets(none), "doc_id") == []
    assert all(r["spans"] == [] for r in secret_scan.find_secrets(mixed).collect())
    rows = docs(spark, [(None, "é password = abcdefghijkl", "a"), (1, "Token: 'short' key AKIAABCDEFGHIJKLMN", None), (1, "secret:abcdefghijkl0123", None), (2, None, None)])
    assert found(secret_scan.digests(secret_scan.find_secrets(rows)), "doc_id", "spans") == sorted([(None, "assign:2:25"), (1, "access:19:37"), (1, "assign:0:23"), (2, "")], key=repr)
    clean = secret_scan.redact(rows)
    assert clean.columns == rows.columns
    assert found(clean, "doc_id", "text", "n_chars") == sorted([(None, "é [SECRET]", 10), (1, "Token: 'short' key [SECRET]", 27), (1, "[SECRET]", 8), (2, None, None)], key=repr)


A, D = "aB3dE5gH7jK9mN1pQ3sT5vX7zB9cD1fG", "0123456789abcdef0123456789abcdef"
#: For each rule beyond the base a text with a match, and one that just misses.
TOKENS = {
    "private_key": ("-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN RSA PUBLIC KEY-----"),
    "code_host": (f"ghp_{A}{A}", f"ghx_{A}{A}"),
    "chat_app": ("xoxb-1234567890", "xoxb-123"),
    "fine_grained": (f"github_pat_{A}{A}", f"github_pat_{A}"),
    "project_host": (f"glpat-{A[:20]}", f"glpat-{A[:19]}"),
    "cloud_key": (f"AIza{A}{A[:3]}", f"AIza{A}{A[:2]}"),
    "cloud_session": (f"ya29.{A}", f"ya28.{A}"),
    "payment": (f"sk_live_{A}", f"sk_lives_{A}"),
    "point_of_sale": (f"sq0atp-{A}", f"sq0abc-{A}"),
    "mailing": (f"SG.{A[:22]}.{A}{A[:11]}", f"SG.{A[:21]}.{A}{A[:11]}"),
    "mail_route": (f"key-{D}", f"key-{D[:31]}"),
    "packages": (f"npm_{A}{A[:4]}", f"npm_{A}{A[:3]}"),
    "package_index": (f"pypi-AgEIcHlwaS5vcmc{A}{A}", f"pypi-AgEIcHlwaS5vcmc{A}"),
    "web_token": (f"eyJ{A}.eyJ{A}.{A}", f"eyJ{A}.{A}.{A}"),
    "shop": (f"shpat_{D}", f"shpat_{D[:31]}"),
    "chat_hook": (f"https://hooks.slack.com/services/{A}", f"https://hooks.slack.org/services/{A}"),
    "chat_bot": (f"12345678:AA{A}x", f"12345678:AA{A}"),
    "droplet": (f"dop_v1_{D}{D}", f"dop_v1_{D}{D[:31]}"),
    "vault": (f"hvs.{A}", f"hvs.{A[:23]}"),
    "file_key": ("AGE-SECRET-KEY-1" + "Q2W3" * 14 + "E4", "AGE-SECRET-KEY-1" + "Q2W3" * 14 + "E"),
    "url_password": ("postgres://user:pass@host/db", "postgres://user@host/db"),
    "bearer": (f"Bearer {A}", f"Bearer {A[:19]}"),
}


def test_secret_rules(spark):
    assert set(TOKENS) == {rule.kind for rule in secret_scan.RULES if not rule.base}
    rows = docs(spark, [(2 * k + miss, f"x \u00e9 {both[miss]} y", "a") for k, both in enumerate(TOKENS.values()) for miss in (0, 1)])
    got = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in secret_scan.find_secrets(rows).collect()}
    for k, kind in enumerate(TOKENS):
        assert kind in got[2 * k] and kind not in got[2 * k + 1], kind


def test_html(spark):
    rows = [(1, None, "<html><body><nav><a href='/'>Home</a></nav><article><h1>Title of it</h1><p>A &amp; b  c.<p>More text, and more.</article><footer>&copy; x</footer>"), (None, "u", None), (3, "u", ""), (4, "u", "<<<>> < p <a href='"), (5, "u", "<p>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.main_text(pages).collect()}
    assert got[1]["text"] == "Title of it\nA & b c.\nMore text, and more." and got[1]["n_chars"] == 41
    assert got[None]["text"] == got[3]["text"] == "" and len(got) == 5
    assert html_extract.main_text(pages.where("page_id = -1")).count() == 0


def test_decontaminate(spark, mixed, none):
    item = "A farmer in Kent has 12 cows and 7 goats, then sells 5 cows to his neighbour for 300 usd in spring."
    other = item.replace("12", "90").replace("Kent", "Devon").replace("300", "45").replace("7", "8")
    broken = item.replace("12 cows and 7 goats", "12 cows and 12 goats").replace("sells 5", "sells 12")
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (None, item, 0), (3, "too short", 0)], "item_id long, text string, hash int")
    rows = docs(spark, [(10, f"Before this. {item} After it.", "a"), (11, f"Some words first. {other}", "a"), (12, "Nothing of that kind is in here at all, only other words.", "a"), (None, item, "a"), (13, None, "a"), (14, broken, "a")])
    got = found(decontaminate.contaminated(rows, bench), "doc_id", "item_id", "exact")
    assert got == sorted([(10, 1, True), (11, 1, False), (None, 1, True)], key=repr)  # 14: one value stands for three of the item's
    assert found(decontaminate.clean_documents(rows, bench), "doc_id") == [(12,), (13,), (14,)]
    twice = docs(spark, [(1, item, "a"), (1, "Other words under the same id stay as they are.", "a"), (1, item, "a"), (None, "No item in here.", "a")])
    assert found(decontaminate.clean_documents(twice, bench), "doc_id", "text") == sorted([(1, "Other words under the same id stay as they are."), (None, "No item in here.")], key=repr)
    assert decontaminate.contaminated(none, bench).count() == decontaminate.contaminated(mixed, bench.where("item_id = -1")).count() == 0


def test_substring(spark, mixed, none):
    passage = " ".join(f"p{i}" for i in range(30)) + ". " + " ".join(f"q{i}" for i in range(30)) + "."
    rows = docs(spark, [(1, f"Own start one. {passage} Own end.", "a"), (2, f"Other begin. {passage} Other end.", "a"), (3, "Clean text. With two sentences.", "a"), (4, None, "a"), (5, "", "a")])
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(rows).collect()}
    assert list(got) == [2] and got[2]["first_doc_id"] == 1 and got[2]["text"] == "Other begin. Other end." and got[2]["removed_words"] == 60
    assert substring_dedup.remove_repeats(none).count() == 0
    assert {r["doc_id"] for r in substring_dedup.remove_repeats(mixed).collect()} == {1, 2}  # null comes first


def test_substring_without_marks(spark):
    """51 words without marks are found at every offset, and passages with marks or spaces of other scripts."""
    import numpy as np

    marks = {"": " ", "danda": "। ", "nbsp": "\u00a0"}
    rows, n = [], 0
    for k in range(16):
        for mark in marks.values():
            passage = mark.join(f"p{n}x{i}" for i in range(51))
            rows += [(2 * n, " ".join(f"a{n}x{i}" for i in range(3)) + f" {passage} " + " ".join(f"b{n}x{i}" for i in range(k)), "a"), (2 * n + 1, " ".join(f"c{n}x{i}" for i in range(k)) + f" {passage} " + " ".join(f"d{n}x{i}" for i in range(5)), "a")]
            n += 1
    han = "".join(chr(0x4E00 + 7 * i) for i in range(60))
    rows += [(2 * n, f"\u6211\u5011{han}", "a"), (2 * n + 1, f"\u4ed6{han}\u3002\u5b8c", "a")]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert sorted(got) == list(range(1, 2 * n + 2, 2)) and all(r["first_doc_id"] == i - 1 and r["removed_words"] >= 20 for i, r in got.items())
    how, rng = substring_dedup.Spans(), np.random.default_rng(5)
    for _ in range(300):  # any mixture of marks, in any surroundings
        middle = "".join(f"m{i}{'. ' if rng.random() < rng.choice([0, 0.1, 0.3]) else ' '}" for i in range(51))
        own = []
        for side in "ab":
            before, after = ("".join(f"{side}{j}{i} " for i in range(rng.integers(0, 20))) for j in "xy")
            words, _, _, _, fresh = substring_dedup.sentences(np.frombuffer((t := (before + middle + after).encode()), np.uint8), np.array([0, len(t)]), how.window)
            own.append(set(substring_dedup.spans(words, np.flatnonzero(fresh), how)[0].tolist()))
        assert own[0] & own[1]


def test_chat(spark):
    rows = [(1, 0, "user", "a<|im_end|>\\"), (1, 1, "user", None), (1, 2, "assistant", "x\\n<|"), (None, None, None, "t"), (2, 0, "assistant", "y"), (2, 0, "assistant", "y"), (2, 0, "a\n<|im_next|>\\n", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    read = {r["conv_id"]: [(t["role"], t["text"], t["loss"]) for t in r["turns"]] for r in chat_format.read_conversations(chat_format.format_conversations(turns)).collect()}
    assert read[1] == [("user", "a<|im_end|>\\", False), ("user", "", False), ("assistant", "x\\n<|", True)]
    assert read[None] == [("", "t", False)]
    assert read[2] == [("a\n<|im_next|>\\n", "z", False), ("assistant", "y", True), ("assistant", "y", True)]
    text = chat_format.format_conversations(turns.where("conv_id = 1")).first()["formatted"]
    assert text.count("<|im_start|>") == 2 and text.count("<|im_next|>") == 1
    assert chat_format.format_conversations(turns.where("conv_id = 9")).count() == 0


def test_packing(mixed, none):
    rows = packing.pack(mixed, ranks(), 64, 16, 8).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 4) == 1 and sum(r["length"] for r in rows if r["doc_id"] == 3) == 1
    assert max(sum(r["length"] for r in rows if r["sequence_id"] == s) for s in {r["sequence_id"] for r in rows}) <= 64
    assert packing.pack(none, ranks()).count() == 0


def test_quality(spark, mixed, none):
    got = found(quality_rules.quality(mixed), "doc_id", "n_words", "base_failed", "kept")
    assert got.count((2, 400, False, True)) == 2 and (3, 0, True, False) in got and (None, 400, False, True) in got and len(got) == len(ROWS)
    assert found(quality_rules.kept_documents(mixed), "doc_id") == sorted([(1,), (2,), (2,), (None,)], key=repr)
    assert quality_rules.quality(none).count() == 0
    line = "a line of nine words that all of them share"
    many = docs(spark, [(i, f"{line}\n" + (f"own{i} " * 2 if i < 30 else " ".join(f"w{i}x{k}" for k in range(12))), "h") for i in range(40)] + [(99, line + " x y z", "other")])
    limits = quality_rules.Limits(line_documents=20, line_percent=5, left_percent=20)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality(many, limits).collect()}
    assert kept[35] and not kept[3] and kept[99]


def test_pii(spark, mixed, none):
    assert pii.personal_data(none).count() == 0
    assert all(r["spans"] == "" for r in pii.digests(pii.personal_data(mixed)).collect())
    secret = "Zebulon called from box@mail.example.org today"
    rows = docs(spark, [(i, f"{secret} {i} times and then left the building {' '.join(f'u{i}v{k}' for k in range(5))}", "a") for i in range(4)] + [(50 + i, f"called from the building today and left again {i}", "a") for i in range(120)] + [(9, "Zebulon é 4111 1111 1111 1111 or +44 (20) 7946-0958 or 10.0.0.256 or 10.0.0.25", None), (8, None, None)])
    data = pii.personal_data(rows)
    got = {r["doc_id"]: r["spans"] for r in pii.digests(data).collect()}
    assert got[9] == "ip:69:78,card:10:29,phone:33:51,term:0:7" and got[8] == "" and got[1].startswith("email:20:40,term:0:7")
    assert {r["doc_id"]: r["text"] for r in pii.sanitised(rows, data, "<TERM>").collect()}[1].startswith("<TERM> called from <EMAIL> today")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(rows, data).collect()}
    assert clean[9] == " é <CARD> or <PHONE> or 10.0.0.256 or <IP>" and clean[1].startswith(" called from <EMAIL> today")


def test_pii_far_terms(spark):
    """A term in the greeting discloses the address in the signature, however much stands between."""
    filler = " ".join(["many", "plain", "words", "of", "a", "letter"] * 20)
    rows = docs(spark, [(i, f"Dear Quixada, number {i}. {filler}. Yours, box@mail.example.org", "a") for i in range(4)] + [(50 + i, f"Dear reader, number {i}. {filler}. Yours, the office", "a") for i in range(120)])
    got = {r["doc_id"]: r["spans"] for r in pii.digests(pii.personal_data(rows)).collect()}
    assert all(got[i].endswith(",term:5:12") for i in range(4)) and all(got[50 + i] == "" for i in range(120))


def test_decontaminate_dense_items(spark):
    """Items full of numbers and names, very short ones and ones without spaces are found verbatim."""
    items = ["What is 12 * 34 + 56?", "Solve for x: 3x + 5 = 20", "Is Paris north of Rome?", "1 2 3 4 5 6 7 8 9 10 11 12 13 14", "\u6c34\u306e\u6cb8\u70b9\u306f\u4f55\u5ea6\u3067\u3059\u304b"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    near = ["What is 12 * 34 + 57?", "Solve for x: 3x + 5 = 21", "Is Rome north of Paris?", "3 1 2 5 4", "\u6c34\u306e\u878d\u70b9\u306f\u4f55\u5ea6\u3067\u3059\u304b"]
    rows = docs(spark, [(i, f"He asked 7 {x} 40 Then More\u6211", "a") for i, x in enumerate(items)] + [(10 + i, f"He asked 7 {x} 40 Then More", "a") for i, x in enumerate(near)])
    got = found(decontaminate.contaminated(rows, bench), "doc_id", "item_id", "exact")
    assert [x for x in got if x[0] != 14] == [(i, i, True) for i in range(5)]


def test_decontaminate_variants(spark):
    """Planted copies, variants with other numbers and names, partial copies and broken variants against a table of made-up items."""
    import random

    r = random.Random(4)
    plain = [f"{a}{b}" for a in "ba co di fu ge lo mi ra su te".split() for b in "lk nd rt sm vo xi".split()]
    names = "Anna Boris Carla Dora Emil Fritz Gina Hugo Ivan Jule Karl Lena Mara Nils Otto Paul".split()

    def item(dense):
        """Words with slots {0}, {1} ...: numbers and names, some of them twice; if dense, two or three in every window."""
        words = [r.choice(plain) for _ in range(r.randint(18, 60))]
        slots, at = [], r.randint(3, 6)
        while at < len(words):
            again = slots and r.random() < 0.25
            k = r.randrange(len(slots)) if again else len(slots)
            if not again:
                slots.append(r.choice(["number", "name"]))
            words[at] = f"{{{k}}}"
            at += 3 if dense else r.randint(4, 9)
        return " ".join(words) + "?", slots

    def values(slots):
        number, name = iter(r.sample(range(2, 900), len(slots))), iter(r.sample(names, min(len(slots), len(names))))
        return [str(next(number)) if k == "number" else next(name) for k in slots]

    items = [item(k % 2) for k in range(60)]
    own = [values(s) for _, s in items]
    texts = [t.format(*v) for (t, _), v in zip(items, own, strict=True)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    around = lambda x: f"{' '.join(r.choice(plain) for _ in range(30))}. {x} {' '.join(r.choice(plain) for _ in range(30))}."
    rows = []
    for k, (t, s) in enumerate(items):
        rows.append((k, around(texts[k]), "copy"))
        rows.append((1000 + k, around(t.format(*values(s))), "variant"))
        half = texts[k].split(" ")
        rows.append((2000 + k, around(" ".join(half[: 1 + len(half) * 3 // 5])), "part"))
        if k % 2:  # all numbers one number, all names one name
            rows.append((3000 + k, around(t.format(*("7" if x == "number" else "Zoe" for x in s))), "broken"))
    rows += [(4000 + k, around(around("")), "clean") for k in range(200)]
    kind = {i: x for i, _, x in rows}
    got = found(decontaminate.contaminated(docs(spark, rows), bench), "doc_id", "item_id")
    assert all(d % 1000 == i for d, i in got)
    share = lambda x: sum(kind[d] == x for d, _ in got) / max(1, sum(v == x for v in kind.values()))
    assert share("copy") == 1 and share("variant") >= 0.95 and share("part") >= 0.95 and share("clean") == 0
    assert share("broken") <= 0.2


def test_decontaminate_probes(spark):
    """Short and dense items verbatim, and a long item of which one of two equal numbers was changed."""
    short = ["What is 12 + 7 * 3 - 4 / 2 + 9?", "Who wrote Hamlet, Macbeth?", "Compute 3 km plus 4 km plus 5 kg plus 7 mm now"]
    long = " ".join(f"w{i}" + (f" {i} " if i in (100, 120) else "") for i in range(212)).replace(" 120 ", " 100 ")
    bench = spark.createDataFrame(list(enumerate([*short, long])), "item_id long, text string")
    rows = docs(spark, [(i, f"Some text goes first. {x} And after it.", "a") for i, x in enumerate(short)] + [(3, long.replace(" 100 ", " 55 ", 1), "a")])
    assert found(decontaminate.contaminated(rows, bench), "doc_id", "item_id") == [(i, i) for i in range(4)]


def test_very_long_texts(spark):
    """A text of 150,000 words, and its copy, through every operator that reads documents or turns."""
    long = " ".join(f"w{i}." if i % 12 == 0 else f"w{i}" for i in range(150_000)) + " password=abcdefghijkl0 box@mail.example.org"
    rows = docs(spark, [(1, long, "a"), (2, long, "a"), (3, "short", "a")])
    got = found(jaccard_join.jaccard_components(rows, 4, 85), "doc_id", "n_shingles", "component_id")
    assert got == [(1, 149_999, 1), (2, 149_999, 1), (3, 1, 3)]
    bench = spark.createDataFrame([(1, " ".join(f"w{i}." if i % 12 == 0 else f"w{i}" for i in range(80_000, 80_100)))], "item_id long, text string")
    assert found(decontaminate.contaminated(rows, bench), "doc_id", "item_id", "n_found") == [(1, 1, 93), (2, 1, 93)]
    assert found(substring_dedup.remove_repeats(rows), "doc_id", "first_doc_id") == [(2, 1)]
    assert {r["doc_id"]: r["n_words"] for r in quality_rules.quality(rows).collect()} == {1: 150_002, 2: 150_002, 3: 1}
    assert [len(r["spans"]) for r in secret_scan.find_secrets(rows).orderBy("doc_id").collect()] == [1, 1, 0]
    assert [r["n_email"] for r in pii.digests(pii.personal_data(rows)).orderBy("doc_id").collect()] == [1, 1, 0]
    pieces = packing.pack(rows, ranks()).collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] == 1) == next(r["doc_tokens"] for r in pieces if r["doc_id"] == 1) > 300_000
    turns = spark.createDataFrame([(1, 0, "user", long + "<|im_end|>"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    read = chat_format.read_conversations(chat_format.format_conversations(turns)).first()["turns"]
    assert [t["text"] for t in read] == [long + "<|im_end|>", long]


def test_pipeline_edges(spark, tmp_path):
    """Null ids and texts, repeated rows and ids, clashing columns, and an empty table."""
    import corpus_pipeline

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60)) + "."
    rows = docs(spark, [(1, text(1), "a"), (1, text(1), "a"), (2, text(1), None), (None, text(3), "a"), (3, None, "a"), (4, "", "a"), (5, text(5), "b"), (5, text(6), "b"), (6, f"{text(7)} {text(8)} password=abcdefghijkl0", "b")])
    bench = spark.createDataFrame([(1, text(8)), (None, None)], "item_id long, text string")
    for name, table in (("some", rows), ("none", rows.where("doc_id = -1"))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert sorted({r["doc_id"] for r in pieces}, key=repr) == [1, 5, None] and sum(r["start"] == 0 for r in pieces) == 3
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
