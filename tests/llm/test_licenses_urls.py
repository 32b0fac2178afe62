import math
import re

from footfall.llm import licenses, urls

SEP = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_base(text):
    ws = re.findall(SEP, lower(text))
    found = []
    for phrase, label in licenses.BASE_PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
    return len(ws), sorted(found)


def brute_labels(text, templates, threshold=0.9):
    labels, best = set(), 0.0
    ws = re.findall(SEP, lower(text))
    for label, t in templates:
        own = re.findall(SEP, lower(t))
        want, size = set(own), licenses.block_size(own)
        assert size >= 2 * len(own)
        for at in range(0, max(1, len(ws) - size // 2), size // 2):
            shared = len(want & set(ws[at : at + size]))
            if shared >= math.ceil(round(threshold * len(want), 9)):
                labels.add(label)
                best = max(best, shared / len(want))
    return labels, best


def wrapped(text, width):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            out.append(line)
            line = ""
        line += " " + w
    return "\n".join([*out, line])


MIT, BSD, APACHE = (next(t for label, t in licenses.TEMPLATES if label == want and len(t) > 300) for want in ("mit", "bsd", "apache-2"))
TEXTS = [
    "Released under the MIT License.",
    "x under the mit license under the MIT-license, apache license version 2 cc by nc cc by nc",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the GNU General Public License, version 2",
    "prose\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software\nmore",
    "word " * 100 + "licensed under cc by sa 4.0 " + "word " * 100,
    "licensed under the \u212aernel mit licence",
    "mit mit mit",
    "",
    None,
    "Ünder the mït license",
    "the of to a " * 50,
    "some prose first\n" * 30 + wrapped(MIT, 60) + "\n\nand prose after " * 20,
    "# " + wrapped(BSD, 50).replace("\n", "\n# "),
    wrapped(APACHE, 72).upper(),
    "licensed under the gnu\ngeneral public license\nversion 3",
    " ".join(MIT.split()[:60]),
]


def test_base_and_labels_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS label")
    out = {r["doc_id"]: r for r in licenses.op4_license_scan(df).collect()}
    for i, text in enumerate(TEXTS):
        n, places = brute_base(text)
        labels, best = brute_labels(text, licenses.TEMPLATES)
        r = out[i]
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({p[1] for p in places}))
        assert r["labels"] == ",".join(sorted({p[1] for p in places} | labels))
        assert abs(r["score"] - (1.0 if places else best)) < 1e-12
    for i, label in enumerate(("mit", "bsd", "apache-2", "gpl-3")):
        assert label in out[12 + i]["labels"].split(",")


def test_other_templates_and_thresholds(spark):
    templates = [("t1", "a b c d e f g h"), ("t2", "the quick brown fox"), ("t3", "lone")]
    texts = ["a b c d e f", "a b c d e f g", "quick brown the", "fox the quick brown dog", "lone wolf", "h g f e d c b a " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    templates.append(("t4", " ".join(f"w{i}" for i in range(80))))  # longer than any block of the others
    texts.append(templates[3][1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.5, 0.75, 1.0):
        out = licenses.scan_licenses(df, templates, threshold=threshold).collect()
        for r in out:
            labels, best = brute_labels(texts[r["doc_id"]], templates, threshold)
            assert {m["label"] for m in r["matches"]} == labels
            assert abs(max([m["containment"] for m in r["matches"]], default=0.0) - best) < 1e-12


def test_license_odd_rows(odd_docs, no_docs):
    assert licenses.op4_license_scan(odd_docs).count() == odd_docs.count()
    assert licenses.op4_license_scan(no_docs).count() == 0


def brute_url(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = lower(re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(re.match("[^/?#]*", rest)[0]) :])[0]
    best = None
    for verdict, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best[1] if best else None, best[0] if best else "allow"


URLS = [
    "https://a.Example.NET/en/1", "http://example.net/en", "http://net/", "http://net", "https://xnet/", "http://b.example.com/de/x?y#z",
    "http://example.com/DE/", "https://q.org/fr/a/b/c/", "http://h.org?x=/fr/", "no scheme", "", None, "http://", "://x.net/en/",
    "http://u@x.net:80/", "http://x.net/a://b", "https://deep.er.sub.example.net/en/page/", "http://.net/",
]


def test_urls_match_brute_force(spark):
    df = spark.createDataFrame([*enumerate(URLS), (None, "http://a.net/"), (0, URLS[0])], "page_id long, url string")
    df = df.selectExpr("*", "'x' AS host", "'y' AS rule", "1 AS row")
    rules = [*urls.BASE_RULES, ("block", "x.net/a"), ("allow", "net/a:")]
    table = urls.rule_table(spark, rules)
    for limit in (200_000, 0):
        out = urls.filter_urls(df, table, broadcast_rules=limit, salts=3).collect()
        assert len(out) == df.count()
        for r in out:
            url = URLS[r["page_id"]] if r["page_id"] is not None else "http://a.net/"
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_url(url, rules)


def test_no_pages(spark):
    assert urls.op5_url_filter(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
