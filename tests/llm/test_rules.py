"""Quality rules and license scans against plain Python."""

import collections
import dataclasses
import itertools
import random
import re

from folioq.llm import licenses as L, quality as Q


def counted(t):
    w = t.encode().split()
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    repeated = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(c in Q.SYMBOLS for c in t), dup, len(repeated)


def test_quality_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.op9_quality_rules(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = counted(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])
    judged = collections.Counter((labels[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in labels and not r["base_failed"])
    assert judged[0, False] >= 0.9 * (judged[0, False] + judged[0, True]) and judged[1, True] >= 0.98 * (judged[1, True] + judged[1, False])


def test_counts_of_odd_texts(spark):
    rnd = random.Random(5)
    texts = ["", " \n\t ", "a" * 5, "x " * 100, "a b c d e f g h " * 3, "l1\nl1\r\nl1\n\n \n", "é ü x", "*#|<>&%$ *"] + [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(5, 60))) for _ in range(60)] + ["w%d " % (k % 500) * 1 for k in range(3)] + [" ".join(f"w{k % 700}" for k in range(20_000))]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(99, None, 1)], "doc_id int, text string, n_words int")
    for r in Q.quality(df, []).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counted(r["text"] or "")
    assert Q.quality(df.limit(0), []).collect() == [] and Q.kept(df, []).columns == df.columns and Q.kept(df, []).count() == sum(r["kept"] for r in Q.quality(df, []).collect())


def test_learning():
    rnd = random.Random(1)
    rows = [[rnd.random(), rnd.random()] for _ in range(3000)]
    bad = [(a > 0.8 and b < 0.5) or a < 0.05 for a, b in rows]
    rules = Q.learn(rows, bad, ("a", "b"))
    hit = [any(all(r[("a", "b").index(n)] > c if s == ">" else r[("a", "b").index(n)] <= c for n, s, c in rule.literals) for rule in rules) for r in rows]
    assert sum(h and not b for h, b in zip(hit, bad)) <= 0.1 * sum(hit) and sum(h and b for h, b in zip(hit, bad)) >= 0.85 * sum(bad)
    assert Q.learn(rows, [False] * 3000, ("a", "b")) == [] and Q.learn([], [], ("a", "b")) == []


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "w " * 30), (2, " ".join(f"w{k}" for k in range(30)))], "doc_id int, text string")
    none = spark.createDataFrame([], "doc_id int, quality int")
    assert Q.fit(docs, none) == [] and {r["doc_id"]: r["kept"] for r in Q.quality(docs, []).collect()} == {1: False, 2: True}
    nulls = spark.createDataFrame([(None, 1), (1, None), (1, 0), (1, 1)], "doc_id int, quality int")
    assert Q.fit(docs, nulls) == []


def phrases(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower().decode())
    at = [(i, label) for p, label in L.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_license_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = L.op10_license_scan(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == phrases(docs[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_detections(spark):
    texts = ["cc by nc cc-by-nc 4.0 SPDX-License-Identifier: MIT", None, "", "Licensed under the BSD 3-Clause License. under the mit license", "a.", "permission is hereby granted, free of charge, to any person obtaining a copy", "UNDER THE MİT LICENSE under theé mit license", "no license here", "GNU General Public License, version 3 or later", "under under the mit license license"]
    df = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id int, text string, labels string")
    got = {r["doc_id"]: r for r in L.licenses(df).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == phrases(t or "")
    assert [got[k]["labels"] for k in (0, 3, 5, 7, 8)] == ["cc-by-nc,cc-by-nc-4.0,mit", "bsd-3-clause,mit", "mit", "", "gpl-3"] and got[0]["score"] == 1.0
    assert all(not (b["start"] <= a["start"] and b["stop"] >= a["stop"]) for r in got.values() for a in r["detections"] for b in r["detections"] if a["id"] != b["id"])
    assert len(L.signatures()) > 300 and all(re.compile(s.pattern) for s in L.signatures())
    assert L.licenses(df.limit(0)).collect() == []


def spellings(tree):
    """A text for each way through the alternatives and options of a parsed pattern."""
    parts = []
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            parts.append([chr(arg)])
        elif op == "IN":
            parts.append([chr(arg[0][1]) if str(arg[0][0]) == "LITERAL" else "1" if "DIGIT" in str(arg[0][1]) else "w"])
        elif op == "SUBPATTERN":
            parts.append(spellings(arg[3]))
        elif op == "BRANCH":
            parts.append([x for branch in arg[1] for x in spellings(branch)])
        else:
            assert op == "MAX_REPEAT"
            parts.append([x * n for n in (arg[0], arg[0] + 1) for x in spellings(arg[2])])
    return sorted({"".join(x) for x in itertools.product(*parts)})


def test_every_spelling_has_a_keyword(spark):
    for s in L.signatures():
        for text in spellings(re._parser.parse(s.pattern)):
            assert set(s.keyword.split()) & set(text.split()), (s, text)
    names = [x for _, name in L.FAMILIES.values() for x in spellings(re._parser.parse(name))]
    df = spark.createDataFrame([(f"{x} zzz",) for n in names for x in (f"{n} license", f"SPDX-License-Identifier: {n}")], "text string").repartition(4)
    scan = lambda rules: {r["text"]: (r["labels"], r["score"]) for r in L.licenses(df, rules=rules).collect()}
    gated = scan(None)
    assert gated == scan([dataclasses.replace(s, keyword="zzz") for s in L.signatures()])
    assert gated["expat license zzz"] == ("mit", 0.7) and gated["SPDX-License-Identifier: 0bsd zzz"] == ("bsd-0-clause", 1.0)


def test_no_python_on_the_native_path(spark):
    sf = "/root/testdata/sf0.001"
    for q in (Q.op9_quality_rules, L.op10_license_scan):
        plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_every_text_signature_is_found(spark):
    rows = []
    for k, (label, _, pattern, _, _) in enumerate(L.TEXTS):
        rows += [(f"{k}/{j}", label, t + " zzz") for j, t in enumerate(spellings(re._parser.parse(pattern)))]
    df = spark.createDataFrame(rows, "id string, want string, text string").repartition(4)
    scan = lambda rules: {r["id"]: r for r in L.licenses(df, rules=rules).collect()}
    gated, whole = scan(None), scan([dataclasses.replace(s, keyword="zzz") for s in L.signatures()])
    for i, want, text in rows:
        assert gated[i]["detections"] == whole[i]["detections"] and gated[i]["detections"], text
        assert want in gated[i]["labels"].split(",") or any(d["stop"] - d["start"] >= len(text.split()) - 1 for d in gated[i]["detections"]), (want, gated[i]["labels"], text)


def test_suppression_against_all_pairs(spark):
    rnd = random.Random(8)
    parts = ["licensed under the mit license", "mit license", "under the apache license version 2", "gpl", "gnu gpl v3", "cc by nc 4 0", "plain words", "spdx license identifier mpl 2 0", "all rights reserved"]
    texts = [" ".join(rnd.choice(parts) for _ in range(n)) for n in (1, 5, 40, 300, 2000)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: r["detections"] for r in L.licenses(df).collect()}
    rules = L.signatures()
    for k, t in enumerate(texts[:4]):
        norm, found = f" {t} ", []
        for i, r in enumerate(rules):
            found += [(norm[: m.start()].count(" "), norm[: m.end()].count(" "), i, r) for m in re.finditer(f" {r.pattern}(?= )", norm)]
        lose = lambda x: any(y[0] <= x[0] and y[1] >= x[1] and (y[1] - y[0], y[3].priority, -y[2]) > (x[1] - x[0], x[3].priority, -x[2]) for y in found)  # noqa: B023, E731
        assert sorted((d["start"], d["stop"], d["id"]) for d in got[k]) == sorted((a, b, i) for a, b, i, r in found if not lose((a, b, i, r)))
    assert len(got[4]) > 1000
