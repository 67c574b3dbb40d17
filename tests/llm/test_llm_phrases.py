"""Collocations, posting lists, the filter audit and the url tree against the plainest means, odd rows included."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from math import sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import collocations, filter_audit, url_templates
from tickloom.llm.fm_index import WordIndex
from tickloom.llm.posting_lists import common, difference, gallop, union


def test_index_counts_every_phrase():
    rng = np.random.default_rng(0)
    for _ in range(200):
        size, kinds, longest = (int(rng.integers(*r)) for r in ((0, 60), (1, 6), (2, 7)))
        text = rng.integers(0, kinds, size)
        for length, found in enumerate(WordIndex(text, longest).enumerate(longest), 2):
            wanted = Counter(tuple(text[i:i + length].tolist()) for i in range(size - length + 1) if (text[i:i + length] > 0).all())
            assert {tuple(w.tolist()): int(c) for w, c in zip(found.words, found.count, strict=True)} == wanted


def plain_collocations(docs, least, longest, top):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    times, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                times[lang or "und"].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in times.items():
        n, candidates = total[lang], {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                         for q, b in candidates.items())
            if not inside:
                cuts = [(1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                rows.append((" ".join(p), a, left, right, n, score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows[:top])]
    return sorted(out)


def collocation_rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def texts():
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice(["New ", "york ", "the ", "of ", "a\t", "ü ", "\xa0 ", "b. ", "c,\n", "! ", "d\x0b", "e\r"]) for _ in range(n))
    out = [(rng.choice(["en", "en", "de", None]), say(rng.randint(0, 60))) for _ in range(80)]
    return [*out, *out[:9], ("en", None), ("en", ""), (None, "x"), ("fr", ". , !"), ("en", say(4000)), ("es", "one two three four five six")]


@pytest.fixture(scope="module")
def spoken(spark, tmp_path_factory):
    rows = [(i // 2 if i % 7 == 3 else None if i % 31 == 5 else i, lang, text, "p", 1, 2) for i, (lang, text) in enumerate(texts())]
    path = str(tmp_path_factory.mktemp("spoken"))
    spark.createDataFrame(rows, "doc_id long, lang string, text string, phrase string, a int, part int").repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(("least", "top", "shard_words"), [(3, 2000, 50), (2, 7, 2_000_000), (40, 100, 300)])
def test_collocations(spoken, least, top, shard_words):
    found = collocations.collocations(spoken, least=least, top=top, shard_words=shard_words)
    wanted = plain_collocations([(r["lang"], r["text"]) for r in spoken.collect()], least, 5, top)
    assert wanted and collocation_rows(found) == wanted


def test_collocations_of_nothing(spoken):
    assert collocations.collocations(spoken.filter("doc_id < -1")).count() == 0
    assert collocations.collocations(spoken, least=10**6).count() == 0


def test_scores_beyond_64_bits(spark):
    row = spark.sql("select 5000000000000L n, 4000000000000L a, 4000000000001L l, 4100000000000L r")
    score = row.selectExpr("(1000BD * cast(a as decimal(18,0)) * n) div (cast(l as decimal(19,0)) * r) as score").first()["score"]
    assert score == 1000 * 4000000000000 * 5000000000000 // (4000000000001 * 4100000000000)


def test_posting_lists():
    rng = random.Random(1)
    for _ in range(300):
        lists = [sorted(rng.sample(range(rng.choice([12, 60, 4000])), rng.randint(0, 12))) for _ in range(rng.randint(0, 5))]
        assert union(lists) == sorted(set().union(*lists))
        for a in lists:
            for b in lists:
                assert difference(a, b) == sorted(set(a) - set(b))
                assert common(a, b) == len(set(a) & set(b))
            for sought in range(-1, 14):
                assert gallop(a, sought, 0) == sum(x < sought for x in a)


def plain_audit(docs, labels):
    first, good, toxic = {}, set(), set()
    for d, _, t in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    for d, q, x in labels:
        good |= {d} if q == 1 else set()
        toxic |= {d} if x == 1 else set()
    parts = defaultdict(list)
    for d, lang, t in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and t in first and d > first[t]}
        parts[lang or ""].append(({f for f, bad in fails.items() if bad}, d is not None and d in good, d is not None and d in toxic))
    out = []
    for part, rows in parts.items():
        removed = {}
        for order in permutations("ABCDE"):
            left = rows
            for i, f in enumerate(order):
                out_now = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                fails = sum(f in r[0] for r in rows)
                removed["".join(order), i + 1] = (f, len(left), len(out_now), fails - len(out_now), sum(r[0] == {f} for r in rows),
                                                  sum(r[1] for r in out_now), sum(r[2] for r in out_now))
        shares = Counter()
        for f, _, n, *_ in removed.values():
            shares[f] += n
        out += [(part, order, step, *row[1:], shares[row[0]]) for (order, step), row in removed.items()]
    return sorted(out)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit(spark, spoken):
    labels = [(0, 1, 1), (1, 1, 0), (1, 0, 1), (2, 0, 0), (3, None, 1), (None, 1, 1), (40, 1, None)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audited(spoken, frame)
    rows = sorted(tuple(r[c] for c in AUDIT) for r in found.collect())
    assert rows == plain_audit([(r["doc_id"], r["lang"], r["text"]) for r in spoken.collect()], labels)
    assert filter_audit.audited(spoken.filter("doc_id < -1"), frame).count() == 0
    assert filter_audit.audited(spoken, frame.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_audit_over_many_ranges(spark, spoken, monkeypatch):
    labels = spark.createDataFrame([(4, 1, 1)], "doc_id long, quality int, toxic int")
    whole = filter_audit.audited(spoken, labels).collect()
    monkeypatch.setattr(filter_audit, "RANGE_ROWS", 5)
    assert sorted(filter_audit.audited(spoken, labels).collect()) == sorted(whole)


def plain_tree(urls):
    """(host, path, rule, verdict, template) of every url, level by level over plain lists."""
    parsed = []
    for url in urls:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
        path = m[2] if m else ""
        fit = [r for r in url_templates.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fit, key=lambda r: len(r.name), default=None)
        segments = re.sub("[0-9]+", "#", re.sub("[0-9A-Fa-f]{16,}", "#", path)).split("/")[1:]
        parsed.append({"host": host, "path": path, "rule": rule, "segments": segments, "template": "", "bad": rule and int(rule.verdict == "block")})
    for level in range(url_templates.DEPTH):
        nodes = defaultdict(lambda: defaultdict(list))
        for p in parsed:
            if len(p["segments"]) > level:
                nodes[p["host"], p["template"]][p["segments"][level]].append(p)
        shares = lambda ps: {"bad": (sum(p["bad"] or 0 for p in ps), sum(p["bad"] is not None for p in ps)),
                             "end": (sum(len(p["segments"]) == level + 1 for p in ps), len(ps))}
        for branches in nodes.values():
            node = shares([p for ps in branches.values() for p in ps])
            for segment, ps in branches.items():
                own = shares(ps)
                apart = any(own[k][1] and abs(own[k][0] / own[k][1] - node[k][0] / node[k][1])
                            > url_templates.BOUND * (1 / sqrt(own[k][1]) + 1 / sqrt(node[k][1])) for k in own)
                usual = len(ps) >= url_templates.LEAST_ROWS and len(ps) * url_templates.SHARE >= node["end"][1]
                for p in ps:
                    p["template"] += "/" + (segment if usual and apart else url_templates.MERGED)
    label = lambda ps: (sum(p["bad"] or 0 for p in ps), sum(p["bad"] is not None for p in ps))
    bad, n = label(parsed)
    overall, weight = bad / n if n else 0.0, url_templates.WEIGHT
    out = []
    for p in parsed:
        hb, hn = label([q for q in parsed if q["host"] == p["host"]])
        tb, tn = label([q for q in parsed if (q["host"], q["template"]) == (p["host"], p["template"])])
        purity = 1 - (tb + weight * ((hb + weight * overall) / (hn + weight))) / (tn + weight)
        own = "block" if purity < url_templates.LEAST_PURITY else "allow"
        out.append((p["host"], p["path"], p["rule"] and p["rule"].name, p["rule"].verdict if p["rule"] else own, p["template"]))
    return out


def odd_urls():
    rng = random.Random(2)
    hosts = ["a.com", "b.A.Com", "x.example.org", "example.org", "q.net", "notexample.org", "de.com", "dark.com"]
    made = [f"http://{rng.choice(hosts)}/{rng.choice(['fr', 'de', 'en', 'es', 'FR'])}/{rng.choice(['1', '12', 'x', '9f8e7d6c5b4a39281', ''])}"
            f"{rng.choice(['', '/', '.html', '?a=/de/', '#/fr/'])}" for _ in range(400)]
    dark = [f"https://dark.com/de/{i}/a/b/c/d/e" for i in range(60)] + [f"https://dark.com/de{i}" for i in range(30)]
    return [*made, *dark, None, "", "plain", "x://", "://h", "a://h://i/de/", "http://com/de/", "http://com", "http://org/?", "http://q.net/\n/é ü/*"]


def test_tree(spark):
    urls = odd_urls()
    frame = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, template string")
    found = url_templates.judged(frame, keep=["page_id"]).orderBy("page_id").collect()
    wanted = plain_tree(urls)
    assert [tuple(r[c] for c in ("host", "path", "rule", "verdict", "template")) for r in found] == wanted
    assert {"allow", "block"} <= {v for _, _, rule, v, _ in wanted if rule is None}
    assert url_templates.judged(frame.limit(0), keep=["page_id"]).count() == 0
    with pytest.raises(ValueError, match="results"):
        url_templates.judged(frame, keep=["host"])


def test_tree_without_rules(spark):
    frame = spark.createDataFrame([(None, "http://a/b/c"), (1, None)], "page_id long, url string")
    assert {(r["rule"], r["verdict"]) for r in url_templates.judged(frame, keep=["page_id"], rules=()).collect()} == {(None, "allow")}


def test_native_plan(spark, folder):
    plan = url_templates.judged(spark.read.parquet(f"{folder}/pages.parquet"), keep=["page_id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
    assert plan.filter(F.col("verdict").isNull()).count() == 0
