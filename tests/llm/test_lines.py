import hashlib
from collections import defaultdict

from footfall.llm import lines

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=40, min_docs=5):
    holders = defaultdict(list)
    split = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for d, ls in split:
        for k in {key(x) for x in ls}:
            if len(k) >= min_chars:
                holders[k].append(d)
    keeper = {k: max((d for d in ds if d is not None), default=None) for k, ds in holders.items() if len(ds) >= min_docs}
    out = []
    for d, ls in split:
        kept = [x for x in ls if key(x) not in keeper or keeper[key(x)] == d]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_lines", "2 AS keep", "3 AS pos")
    return sorted((tuple(r) for r in lines.op10_line_dedup(df).collect()), key=str)


def test_against_brute_force(spark):
    a = "Subscribe to our newsletter for more of these articles"
    b = "Ärger über die Straße: ÖFFNUNGSZEITEN finden Sie im Büro"
    rows = [(i, "\n".join([f"own line number {i} of this document, long enough", f"  {a.upper() if i % 2 else a}\t", b, "short"])) for i in range(7)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, "\n".join([a] * 200)), (24, a), (24, a), (None, a + "\n" + a), (25, b.lower())]
    twice = "This line stands twice in one of the four documents that hold it"
    rows += [(40 + i, "\n".join([twice, "x", twice] if i == 2 else [twice])) for i in range(4)]
    rows += [(30 + i, "exactly forty characters long this line!"[:40 - (i == 4)]) for i in range(5)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_texts_and_bitmaps(spark, odd_docs):
    a = "Subscribe to our newsletter for more of these articles"
    rows = [(i, "\n".join([f"x{i}"] * 70 + [a] + ["y"])) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    maps = {r["doc_id"]: r for r in lines.keep_bitmaps(df).collect()}
    assert set(maps) == {0, 1, 2, 3, 4}
    assert maps[0]["keep"] == {1: ~(1 << 6)} and maps[0]["n_dropped"] == 1
    texts = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    assert a not in texts[0] and a in texts[5]
    out = lines.drop_repeated_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
