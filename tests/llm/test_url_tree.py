"""The path-template tree of op4: what is collected, and which branches merge."""

from __future__ import annotations

from corpusloom.llm import url_filter
from corpusloom.llm.shared import staged


def test_segments_of_a_hot_host_are_never_collected(spark, monkeypatch):
    plans = []

    def watched(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return staged(df, name)

    monkeypatch.setattr(url_filter, "staged", watched)
    rows = [(i, "hot.com", f"/s{i % 40}/p", None) for i in range(40 * 25)] + [(-i, "hot.com", "/big/p", None) for i in range(1, 101)]
    urls = spark.createDataFrame(rows, "key long, host string, path string, label int")
    templates, _ = url_filter.template_tree(urls)  # 40 segments have the support, one of them the share
    assert {r.template for r in templates.collect()} == {"/*/p", "/big/p"}
    tree = [p for p in plans if "segment" in p]
    assert tree and not any("collect_list(" in p for p in tree)


def test_alike_subtrees_merge_level_by_level(spark):
    bad = {"/news": 0, "/blog": 0, "/spam": 1, "/shop/a": 0, "/shop/b": 0, "/mix/a": 0, "/mix/b": 1}
    rows = [(f"{p}/{i}", v) for p, v in bad.items() for i in range(60)] + [("/few/a/b", 1)] * 25 + [("/few/a/c", None)] * 25
    urls = spark.createDataFrame([(i, "h.com", *r) for i, r in enumerate(rows)], "key int, host string, path string, label int")
    _, branches = url_filter.template_tree(urls)
    got = {r.template: r for r in branches.collect()}
    assert set(got) == {f"{p}/*" for p in bad} | {"/few/a/b", "/few/a/c"}  # one branch each
    same = [["/news/*", "/blog/*", "/shop/a/*", "/shop/b/*"], ["/spam/*", "/few/a/b", "/few/a/c"], ["/mix/a/*"], ["/mix/b/*"]]
    assert sorted(sorted(t for t in got if got[t].branch == b) for b in {r.branch for r in got.values()}) == sorted(map(sorted, same))
    assert got["/news/*"].seen == 60 and got["/few/a/c"].seen == 0


def test_a_sparse_sibling_takes_the_rate_of_the_alike(spark):
    rows = [(f"http://h.com/a/{i}", 1) for i in range(60)] + [(f"http://h.com/b/{i}", 1 if i < 2 else None) for i in range(60)]
    rows += [(f"http://k.com/b/{i}", 0) for i in range(200)]  # the same template is good elsewhere
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, bad int")
    got = url_filter.url_filter(pages, [], label_col="bad").collect()
    assert len(got) == len(rows)
    assert {r.verdict for r in got if r.host == "h.com"} == {"block"} and {r.verdict for r in got if r.host == "k.com"} == {"allow"}


def plain_verdicts(rows, weight=10.0, share=0.05, least=0.8, z=1.96):
    """Template tree, merging and purity in plain loops; ``rows(host, path, label)``."""
    from collections import Counter, defaultdict
    from math import sqrt

    def surely(n, all_):
        p = n / all_
        return n >= 2 and (p + z * z / (2 * all_) - z * sqrt(p * (1 - p) / all_ + z * z / (4 * all_ * all_))) / (1 + z * z / all_) >= share

    rest = [tuple(s for s in p.split("/") if s) for _, p, _ in rows]
    at, final, open_ = [""] * len(rows), [None] * len(rows), set(range(len(rows)))
    while open_:
        by = defaultdict(list)
        for i in open_:
            by[at[i]].append(i)
        for name, own in by.items():
            if len({rest[i] for i in own}) == 1:
                for i in own:
                    tail = rest[i] if len(own) > 1 else ["*"] * len(rest[i])
                    final[i] = (name + "".join("/" + s for s in tail), (name + "/").split("/")[:-1] + ["\x1f".join(tail)])
            for i in own:
                if final[i] is None and not rest[i]:
                    final[i] = (name, (name + "/").split("/"))
        open_ = {i for i in open_ if final[i] is None}
        here = Counter((rows[i][0], at[i], rest[i][0]) for i in open_)
        node = Counter((rows[i][0], at[i]) for i in open_)
        pool = Counter((at[i], rest[i][0]) for i in open_)
        whole = Counter(at[i] for i in open_)
        step = {}
        for i in open_:
            h, t, s = rows[i][0], at[i], rest[i][0]
            keep = surely(here[h, t, s], node[h, t]) or surely(pool[t, s], whole[t])
            step[i] = f"{t}/{s if keep else '*'}"
        for i, t in step.items():
            at[i], rest[i] = t, rest[i][1:]
    seen, bad = Counter(), Counter()
    for (h, _, label), (t, path) in zip(rows, final, strict=True):
        seen[h, t, tuple(path)] += label is not None
        bad[h, t, tuple(path)] += label or 0
    s_all, b_all, s_by, b_by = Counter(), Counter(), Counter(), Counter()
    for k, n in seen.items():
        s_all[k[1]] += n
        b_all[k[1]] += bad[k]
    up = lambda t: t.rpartition("/")[0]
    for t in s_all:
        s_by[up(t)] += s_all[t]
        b_by[up(t)] += b_all[t]
    overall = sum(bad.values()) / seen.total() if seen.total() else 0.5
    prior = {t: (b_all[t] + weight * (b_by[up(t)] + weight * overall) / (s_by[up(t)] + weight)) / (s_all[t] + weight) for t in s_all}
    tree = {}
    for k, n in seen.items():
        lent = min(weight, s_all[k[1]])
        tree[k[0], k[2]] = (n, bad[k]) if n else (lent, lent * b_all[k[1]] / s_all[k[1]] if s_all[k[1]] else 0.0)
    branch, now = {}, {}
    for level in range(max(len(p) for _, p in tree) - 1, -1, -1):
        now |= {k: (*v, False) for k, v in tree.items() if len(k[1]) == level + 1}
        kids = defaultdict(list)
        for k in [k for k in now if len(k[1]) == level + 1]:
            kids[k[0], k[1][:-1]].append((k, *now.pop(k)))
        if not level:
            for k, *_, mixed in (x for v in kids.values() for x in v):
                branch[k] = k if not mixed else None
            break
        for parent, own in kids.items():
            s, b = sum(x[1] for x in own), sum(x[2] for x in own)
            groups, mixed = [], any(x[3] for x in own)
            order = sorted((x[2] / x[1] if x[1] else (b / s if s else 0.0), "/".join(x[0][1]), *x[:3]) for x in own if not x[3])
            for _, _, k, n, m in order:
                apart = False
                if groups and n and groups[-1][0]:
                    gs, gb, _ = groups[-1]
                    p = (m + gb) / (n + gs)
                    apart = abs(m / n - gb / gs) > z * sqrt(max(0.0, p * (1 - p) * (1 / n + 1 / gs)))
                if not groups or apart:
                    groups.append([n, m, [k]])
                else:
                    groups[-1] = [groups[-1][0] + n, groups[-1][1] + m, [*groups[-1][2], k]]
            mixed |= len(groups) > 1
            now[parent] = (0, 0, True) if mixed else (*groups[0][:2], False)
            for g in groups if mixed else []:
                for k in g[2]:
                    branch[k] = min(g[2], key=lambda k: "/".join(k[1]))
    out, sums = [], defaultdict(lambda: [0, 0])

    def of(k):
        return next(branch[k[0], k[1][:n]] for n in range(len(k[1]) + 1) if branch.get((k[0], k[1][:n])))

    for k, (n, m) in tree.items():
        sums[of(k)][0] += n
        sums[of(k)][1] += m
    for (h, _, _), (t, path) in zip(rows, final, strict=True):
        s, b = sums[of((h, tuple(path)))]
        out.append((t, (b + weight * prior[t]) / (s + weight)))
    return out


def test_the_whole_query_is_the_plain_versions(spark):
    from corpusloom.llm.queries import URL_RULES

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    more = [(10_000 + i, f"http://x{i % 7}.org/shop/{i % 3}/{i}/view{'/deep' * (i % 4)}") for i in range(300)]
    more += [(20_000, "http://long.org/" + "a/" * 3000), (20_001, "http://long.org/" + "a/" * 2999 + "b"), (20_002, None), (20_003, "x")] + [(20_004, "http://long.org/" + "q/" * 5000)] * 2
    got = url_filter.url_filter(pages.unionByName(spark.createDataFrame(more, pages.schema)), URL_RULES).collect()
    label = {None: None, "block": 1, "allow": 0}
    said = [r.verdict if r.rule else None for r in got]
    want = plain_verdicts([(r.host, r.path, label[v]) for r, v in zip(got, said, strict=True)])
    for r, (t, purity) in zip(got, want, strict=True):
        assert r.template == t and abs(r.purity - purity) < 1e-9, r
        assert r.rule or r.verdict == ("block" if purity >= 0.8 else "allow")
    free = {v: sum(r.rule is None and r.verdict == v for r in got) for v in ("block", "allow")}
    assert min(free.values()) > 10  # the method decides, both ways


def test_jobs_follow_branchings_and_not_depth(spark, monkeypatch):
    written = []
    monkeypatch.setattr(url_filter, "staged", lambda df, name: (written.append(name), staged(df, name))[1])

    def tables(depth):
        written.clear()
        rows = [(i, f"http://h.org/{'a/' * depth}{i % 2}/{'b/' * depth}{i % 3}/{i}") for i in range(60)]
        got = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string"), []).collect()
        assert len({r.template for r in got}) == 6 and all(r.template.count("/") == 2 * depth + 3 for r in got)
        return len(written)

    assert tables(2) == tables(400) < 60
