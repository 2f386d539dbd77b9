import random
import re
from collections import Counter, defaultdict

from tidemark.llm import urls as U


def slow_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max(((h, p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_parse_and_rules(spark):
    urls = ["http://WWW.Example.NET/en/1?x=/de/", "https://example.net/en", "http://a.example.com/de/2#y", "http://xexample.com/de/", "ftp://b.org/fr/", "x://c.org?/fr/", "nothing", "", None, "http://É.org/fr/ä", "a://b://c.net/d", "http:///path", "http://net/", "http://a.net\n/b"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    h, p = U.parse(df.url)
    rule, verdict = U.match_rule(h, p, U.RULES)
    got = [tuple(r)[1:] for r in df.select("url", h, p, rule, verdict).collect()]
    assert got == [slow_rule(u) for u in urls]


def test_templates_and_purity(spark):
    rows = [(i, f"http://good.example/post/{i}") for i in range(60)] + [(1000 + i, f"http://good.example/promo/w{i * 7919 % 1000}x") for i in range(60)] + [(2000 + i, f"http://other.example/{s}/{i}") for s in ("a", "b", "c") for i in range(10)]
    rows += [(5000, None), (5001, "junk"), (0, "http://good.example/post/0"), (None, "http://good.example/post/7"), (5002, "http://deep.example/" + "/".join("abcdefghijklmnopqrst")), (5003, "http://deep.example/" + "x" * 50_000)]
    labels = [(i, 0) for i in range(0, 60, 2)] + [(1000 + i, 1) for i in range(0, 60, 3)] + [(1000, 1), (9999, 1)]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, host string")
    out = U.judge(pages, spark.createDataFrame(labels, "page_id long, bad int")).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert by[1].verdict == "allow" and by[1001].verdict == "block"
    assert by[1001].template == "/promo/*" and by[1].template == "/post/{num}"
    assert by[2000].template == "/(a|+2)/{num}"
    assert by[5000].host == by[5001].host == "" and by[5000].verdict in ("allow", "block")
    assert by[5002].template.endswith("/**")
    assert U.judge(pages.limit(0), spark.createDataFrame([], "page_id long, bad int")).count() == 0
    assert {r.verdict for r in U.judge(pages.where("page_id < 2000"), spark.createDataFrame([], "page_id long, bad int")).collect() if r.rule is None} <= {"allow", "block"}


def test_deep_segments_are_told_apart(spark):
    top = "http://deep.example/a/b/c/d/e/f/g"
    rows = [(i, f"{top}/{'bad' if i % 2 else 'good'}/{i}") for i in range(80)] + [(900, "http://lone.example/" + "/".join("abcdefghijklmnopqrstuvwxyz"))]
    labels = [(i, i % 2) for i in range(0, 60)]
    out = U.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()
    assert {(r.page_id, r.verdict) for r in out if r.page_id < 900} == {(i, "block" if i % 2 else "allow") for i in range(80)}
    assert {r.template for r in out if r.page_id < 900} == {f"/a/b/c/d/e/f/g/{w}/{{num}}" for w in ("bad", "good")}


def brute_templates(rows, labels):
    """(url index: template) and (template: purity) of one host, by plain loops over lists of segments."""
    paths = {i: [re.sub(r"^\d+", "{num}", s) for s in p.split("/") if s] for i, p in rows}
    tree = {i: list(p) for i, p in paths.items()}
    for level in range(max(map(len, tree.values()))):
        wild = []
        for prefix in {tuple(t[:level]) for t in tree.values()}:
            own = [t for t in tree.values() if len(t) > level and tuple(t[:level]) == prefix]
            count = Counter(t[level] for t in own)
            wild += [(prefix, s) for s, n in count.items() if len(count) > 1 and n < max(U.RARE_COUNT, U.RARE_SHARE * len(own)) and s[0] != "{"]
        for t in tree.values():
            if len(t) > level and (tuple(t[:level]), t[level]) in wild:
                t[level] = "*"
    for level in range(max(map(len, tree.values())) - 1, -1, -1):
        renamed = {}
        for prefix in {tuple(t[:level]) for t in tree.values()}:
            shapes = defaultdict(list)
            for s in {t[level] for t in tree.values() if len(t) > level and tuple(t[:level]) == prefix}:
                own = {i: t for i, t in tree.items() if tuple(t[: level + 1]) == (*prefix, s)}
                known = [labels[i] for i in own if i in labels]
                shapes[frozenset(tuple(t[level + 1 :]) for t in own.values())].append((s, len(known), sum(known)))
            for branches in shapes.values():
                for group in U.unite(branches):
                    renamed |= {(prefix, s): f"({group[0]}|+{len(group) - 1})" for s in group if len(group) > 1}
        for t in tree.values():
            if len(t) > level:
                t[level] = renamed.get((tuple(t[:level]), t[level]), t[level])
    template = {i: "/" + "/".join(t) for i, t in tree.items()}
    base = (sum(labels.values()) + 1) / (len(labels) + 2)
    host = (sum(labels.values()) + U.PRIOR * base) / (len(labels) + U.PRIOR)
    purity = {}
    for t in set(template.values()):
        known = [labels[i] for i in template if template[i] == t and i in labels]
        purity[t] = (sum(known) + U.PRIOR * host) / (len(known) + U.PRIOR)
    return template, purity


def test_tree_against_plain_loops(spark):
    for seed in range(3):
        rng = random.Random(seed)
        kinds = [[rng.choice(["a", "b", "cc", "x1", "7z"]) for _ in range(rng.randrange(1, 4))] for _ in range(6)]
        rows = [(i, "/" + "/".join([*rng.choice(kinds), *rng.choice([[str(i)], ["p", str(i)], [f"w{i}"], []])])) for i in range(260)]
        bad = {kind: rng.random() for kind in "abcx7"}
        labels = {i: int(rng.random() < bad[p[1]]) for i, p in rows if rng.random() < 0.3}
        out = U.judge(spark.createDataFrame([(i, "http://h.example" + p) for i, p in rows], "page_id long, url string"), spark.createDataFrame(list(labels.items()), "page_id long, bad int")).collect()
        template, purity = brute_templates(rows, labels)
        assert {r.page_id: r.template for r in out} == template
        assert all(abs(r.purity - purity[r.template]) < 1e-12 and r.verdict == ("block" if r.purity > U.THRESHOLD else "allow") for r in out)


def test_branches_with_little_evidence_stay_apart():
    assert U.unite([("good", 1, 0), ("bad", 1, 1)]) == [["good"], ["bad"]]
    assert U.unite([("a", 0, 0), ("b", 0, 0), ("c", 3, 0), ("d", 1, 0), ("e", 4, 4)]) == [["a", "b"], ["c", "d"], ["e"]]
    assert U.unite([("a", 100, 10), ("b", 90, 12), ("c", 80, 60), ("d", 60, 50)]) == [["a", "b"], ["c", "d"]]


def test_one_label_a_branch(spark):
    rows = [(i, f"http://h.example/{'good' if i % 2 else 'bad'}/{i}") for i in range(40)]
    out = U.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(1, 0), (2, 1)], "page_id long, bad int")).collect()
    assert {r.template for r in out} == {"/good/{num}", "/bad/{num}"}
