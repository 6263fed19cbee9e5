"""Siblings that differ stay apart, whatever lies between them, at any depth."""

from pathmill.llm import urlfilter


def judged(spark, rows, labels):
    pages, known = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {r["page_id"]: r for r in urlfilter.filter_urls(pages, known).collect()}


def test_unlabelled_sibling_is_no_bridge(spark):
    rows = [(i, f"http://h.net/{'abc'[i % 3]}/{i}") for i in range(300)]
    got = judged(spark, rows, [(i, int(i % 3 == 0), 0) for i in range(300) if i % 3 != 1])
    assert [{got[i]["verdict"] for i in range(k, 300, 3)} for k in (0, 2)] == [{"allow"}, {"block"}]
    assert [{got[i]["template"] for i in range(k, 300, 3)} for k in range(3)] == [{"/=a/*"}, {"/=b/*"}, {"/=c/*"}]


def test_small_steps_do_not_join_the_ends(spark):
    rows = [(i, f"http://h.net/{'abcde'[i % 5]}/{i}") for i in range(100)]
    got = judged(spark, rows, [(i, int(i // 5 >= (2, 6, 10, 14, 18)[i % 5]), 0) for i in range(100)])
    assert got[0]["template"] != got[4]["template"] and got[0]["verdict"] == "allow" and got[4]["verdict"] == "block"


def test_split_at_the_sixth_segment(spark):
    rows = [(i, f"http://h.net/2024/05/12/en/x/{'casino' if i % 2 else 'news'}/{i}") for i in range(200)] + [(1000 + i, "http://deep.net/" + "s/" * 300) for i in range(5)] + [(2000, "http://thin.net/a/b/c/d/e/f")]
    got = judged(spark, rows, [(i, 1 - i % 2, 0) for i in range(0, 200) if i % 3])
    assert [{got[i]["verdict"] for i in range(k, 200, 2)} for k in (0, 1)] == [{"allow"}, {"block"}]
    assert got[0]["template"] == "/=2024/=05/=12/=en/=x/=news/*" and got[1]["template"] == "/=2024/=05/=12/=en/=x/=casino/*"
    assert got[1000]["template"] == "/=s" * 300 + "/=" and got[2000]["template"] == "/*" * 6


def plain_templates(entries):
    """{(host, path): template} of [(host, path, bad or None)] by a recursive tree over plain lists."""
    paths = {}
    for host, path, bad in entries:
        n = paths.setdefault((host, path), [0, 0, 0])
        n[0] += 1
        n[1] += bad is not None
        n[2] += bad or 0
    out = {}

    def apart(l1, b1, l2, b2):
        pooled, gap = (b1 + b2) / (l1 + l2), b1 / l1 - b2 / l2
        return gap * gap > urlfilter.MERGE_Z**2 * pooled * (1 - pooled) * (1 / l1 + 1 / l2)

    def grow(node, template, depth):
        longer = {}
        for key, segments in node.items():
            if len(segments) > depth:
                longer[key] = segments
            else:
                out[key] = template
        total = sum(paths[k][0] for k in longer)
        if total < urlfilter.MIN_PAGES or len(longer) == 1:
            for key, segments in longer.items():
                rest = segments[depth:]
                out[key] = template + ("".join(f"/={s}" for s in rest) if total >= urlfilter.MIN_PAGES else "/*" * len(rest))
            return
        children = {}
        for key, segments in longer.items():
            children.setdefault(segments[depth], []).append(key)
        siblings = {}
        for segment, keys in children.items():
            n = sum(paths[k][0] for k in keys)
            fixed = segment if n >= urlfilter.MIN_SHARE * total and n >= urlfilter.MIN_PAGES else None
            s = siblings.setdefault(fixed, [0, 0])
            s[0] += sum(paths[k][1] for k in keys)
            s[1] += sum(paths[k][2] for k in keys)
        order = sorted((f for f in siblings if siblings[f][0]), key=lambda f: ((siblings[f][1] + 1) / (siblings[f][0] + 2), f or "", f is not None, f or ""))
        clusters, unknown = [], [f for f in siblings if not siblings[f][0]]
        for f in order:
            n, bad = siblings[f]
            if clusters:
                own = clusters[-1]
                together = [sum(siblings[g][i] for g in own) for i in (0, 1)]
                if not apart(*together, n, bad) and not apart(*siblings[own[0]], n, bad):
                    own.append(f)
                    continue
            clusters.append([f])
        names = {}
        for own in [*clusters, unknown] if unknown else clusters:
            name = "*" if None in own else "|".join(sorted(f"={g}" for g in own))
            names |= {g: name for g in own}
        parts = {}
        for segment, keys in children.items():
            for k in keys:
                parts.setdefault(names.get(segment, "*"), {})[k] = longer[k]
        for name, part in parts.items():
            grow(part, f"{template}/{name}", depth + 1)

    hosts = {}
    for host, path in paths:
        hosts.setdefault(host, {})[host, path] = path[1:].split("/") if path else []
    for node in hosts.values():
        grow(node, "", 0)
    return out, paths


def plain_purity(templates, paths):
    labelled, bad = (sum(p[k] for p in paths.values()) for k in (1, 2))
    prior = (labelled - bad + 1) / (labelled + 2)

    def pooled(keys, towards):
        n, b = (sum(paths[k][i] for k in keys) for i in (1, 2))
        return (n - b + urlfilter.SMOOTHING * towards) / (n + urlfilter.SMOOTHING)

    groups = {}
    for (host, path), template in templates.items():
        groups.setdefault((host, template), []).append((host, path))
    hosts = {h: pooled([k for k in paths if k[0] == h], prior) for h, _ in paths}
    return {k: pooled(groups[k[0], t], hosts[k[0]]) for k, t in templates.items()}


def test_tree_is_the_plain_one(spark):
    import random

    rng = random.Random(7)
    rows, labels = [], []
    for i in range(1500):
        host = rng.choice(["one.net", "one.net", "two.net", "three.net"])
        segments = [rng.choice(["news", "shop", "es", "", f"p{rng.randrange(40)}"]) for _ in range(rng.randint(0, 5))] + [str(rng.randrange(200))] * rng.randint(0, 1)
        path = "".join(f"/{s}" for s in segments)
        rows.append((i, f"http://{host}{path}"))
        if rng.random() < 0.6:
            labels.append((i, int(rng.random() > (0.8 if "shop" in segments else 0.2)), int(rng.random() < 0.05)))
    rows += [(2000 + i, None) for i in range(5)]
    got = judged(spark, rows, labels)
    bad = {i: int(q == 0 or t > 0) for i, q, t in labels}
    expected, paths = plain_templates([(r["host"], r["path"], bad.get(i)) for i, r in got.items()])
    purity = plain_purity(expected, paths)
    for r in got.values():
        key = r["host"], r["path"]
        assert r["template"] == expected[key] and abs(r["purity"] - purity[key]) < 1e-9
        assert r["rule"] or r["verdict"] == ("block" if purity[key] < urlfilter.MIN_PURITY else "allow")
