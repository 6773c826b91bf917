import re
from collections import Counter

from proofmill.llm.licences import BASE, NOTICES, licence_scan
from proofmill.llm.urlfilter import RULES, url_verdicts, vocabulary_of
from tests.llm.conftest import prose


def test_url_parts_rules_and_terms(spark):
    cases = [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net/x", "example.net", "/x", "net/", "block"),
        ("http://badexample.com/de/x", "badexample.com", "/de/x", None, "allow"),
        ("http://example.com/de", "example.com", "/de", None, "allow"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("x://w.org/fr/casino", "w.org", "/fr/casino", "org/fr/", "allow"),
        ("http://casino-win.example.org/en/", "casino-win.example.org", "/en/", None, "block"),
        ("http://casinos.org/cheap", "casinos.org", "/cheap", None, "block"),
        ("http://casinosx.org/cheap", "casinosx.org", "/cheap", None, "allow"),
        ("http://a.org/cheap/Pills", "a.org", "/cheap/Pills", None, "block"),
        ("http://a.org/cheap/cheap", "a.org", "/cheap/cheap", None, "allow"),
        ("http://a.org/x?casino", "a.org", "/x", None, "allow"),
        ("a.org/casino", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://?", "", "", None, "allow"),
        ("http://é.org/Écasino#://x", "é.org", "/Écasino", None, "block"),
        ("http://" + "a" * 50000 + ".org/" + "b" * 50000, "a" * 50000 + ".org", "/" + "b" * 50000, None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "h", "r") for i, c in enumerate(cases)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_verdicts(pages.union(pages.limit(2))).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert url_verdicts(pages.limit(0)).count() == 0
    assert len({h + p for _, h, p in RULES}) == len(RULES)


def test_urls_of_other_kinds(spark):
    bad = ["http://www.best-online-casinos.biz/", "https://buy-viagra.example.org/order", "http://cdn.x.org/banner/click.js", "http://quick-payday.loan/apply", "http://a.org/free/mp3/", "https://rolex-replica.shop", "http://adult.dating.example.org", "http://t.example.org/pixel/track?id=1", "http://tube.xxx/a"]
    good = ["https://en.example.org/wiki/Betting_odd", "http://university.example.org/adult-education", "http://news.example.org/2019/economy", "https://docs.python.example.org/3/library/os.html", "http://skincare.example.org/", "http://farmersmarket.example.org/free", "https://analytics.example.org/win32", "http://essex.example.org/", "http://classics.example.org/spamalot"]
    pages = spark.createDataFrame(list(enumerate(bad + good)), "page_id int, url string")
    got = {r.page_id: r.verdict for r in url_verdicts(pages, rules=()).collect()}
    assert [got[i] for i in range(len(bad))] == ["block"] * len(bad)
    assert [got[i] for i in range(len(bad), len(got))] == ["allow"] * len(good)


def test_a_vocabulary_can_be_a_table(spark):
    table = spark.createDataFrame([("teapot", 2), ("tea", 1), ("cup", 1), ("cup", 1), (None, 2), ("", 2)], "term string, weight int")
    words = vocabulary_of(table)
    assert words == {"teapot": 2, "tea": 1, "cup": 1}
    pages = spark.createDataFrame([(1, "x://teapot.org"), (2, "x://a.org/tea"), (3, "x://a.org/tea/cup"), (4, "x://casino.org")], "page_id int, url string")
    assert {r.page_id: r.verdict for r in url_verdicts(pages, rules=(), vocabulary=words).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow"}


def expected(rows):
    out = Counter()
    for key, text in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        starts, base, labels, score = [], set(), set(), 0.0
        for t in BASE + NOTICES:
            size = len(t.words.split())
            for s in range(-size, len(w)):
                at = lambda i: w[s + i] if 0 <= s + i < len(w) else None  # noqa: B023, E731
                if all(at(first + i) == x for first, words in t.spans() for i, x in enumerate(words)):
                    labels.add(t.label)
                    share = sum(at(i) == x for i, x in enumerate(t.words.split())) / size
                    if t.base:
                        starts.append(s)
                        base.add(t.label)
                        share = 0.5
                    score = max(score, share)
        out[key, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)] += 1
    return out


def test_licences_against_brute_force(spark, edge_docs, edge_rows, no_docs):
    notes = [
        "Released under the MIT License.", "mit. license! MIT-LICENSE mit  licenses", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
        "gnu general public license", "GNU General Public License version 2", "x Apache License", "Licensed under the Apache License, Version 2.0.", "All rights reserved.", "M\u0130T license",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission is hereby granted, free of charge", "cc by cc by 4.0 cc by",
    ]
    rows = edge_rows + [(300 + i, prose(i, 20) + "\n" + n) for i, n in enumerate(notes)] + [(400 + i, n) for i, n in enumerate(notes)] + [(500, (prose(4, 50) + " mit license ") * 300)]
    docs = spark.createDataFrame([(*r, 1, "x", 1.0) for r in rows], "doc_id long, text string, row int, words string, score double").repartition(3)
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in licence_scan(docs).collect())
    assert got == expected(rows)
    assert licence_scan(no_docs).count() == 0
    plain = licence_scan(edge_docs)
    assert plain.count() == len(edge_rows) and plain.where("labels <> ''").count() == 0
