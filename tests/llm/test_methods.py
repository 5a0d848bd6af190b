"""What the methods themselves decide, on tables made so that they must."""

from __future__ import annotations

import random

from visitlens.llm import secretscan, urlgraph


def power_iteration(hosts, links, seeds, damping, backwards):
    """Personalised PageRank by a plain loop; what a host without links holds goes back to the seeds."""
    mass = sum(seeds.values())
    if not mass:
        return dict.fromkeys(hosts, 0.0)
    seed = {h: seeds.get(h, 0.0) / mass for h in hosts}
    out = {h: {} for h in hosts}
    for (a, b), n in links.items():
        a, b = (b, a) if backwards else (a, b)
        out[a][b] = out[a].get(b, 0) + n
    score = dict(seed)
    for _ in range(400):
        lost = sum(score[h] for h in hosts if not out[h])
        now = {h: (1 - damping) * seed[h] + damping * lost * seed[h] for h in hosts}
        for a, to in out.items():
            total = sum(to.values())
            for b, n in to.items():
                now[b] += damping * score[a] * n / total
        score = now
    return score


def test_verdicts_of_a_linked_crawl(spark):
    """Hosts without a rule, some in a ring of spam that links to blocked ones: verdicts and scores equal a plain power iteration."""
    draw = random.Random(8)
    good, bad, ring, quiet = ([f"{kind}{i}.org" for i in range(6)] for kind in ("good", "bad", "ring", "quiet"))
    rules = [urlgraph.Rule(True, h, "/") for h in good[:3]] + [urlgraph.Rule(False, h, "/") for h in bad[:4]]
    aims = {**{h: good + quiet for h in good}, **{h: bad + ring for h in bad}, **{h: bad[:4] + bad[:4] + ring for h in ring}, **{h: quiet + good for h in quiet}}
    pages, links = [], {}
    for host, targets in aims.items():
        for _ in range(4):
            to = [draw.choice(targets) for _ in range(draw.randint(0, 5))]
            pages.append((len(pages), f"http://{host}/p/{len(pages)}", "".join(f'<a href="http://{t}/">x</a>' for t in to)))
            for t in to:
                if t != host:
                    links[host, t] = links.get((host, t), 0) + 1
    hosts = sorted({*aims, *(t for _, t in links)})
    found = urlgraph.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()
    trust = power_iteration(hosts, links, dict.fromkeys(good[:3], 1.0), 0.85, backwards=False)
    distrust = power_iteration(hosts, links, dict.fromkeys(bad[:4], 1.0), 0.85, backwards=True)
    rank = power_iteration(hosts, links, dict.fromkeys(hosts, 1.0), 0.85, backwards=False)
    by_method = {"allow": 0, "block": 0}
    for r in found:
        h = r.host
        assert abs(r.trust - trust[h]) < 1e-5 and abs(r.distrust - distrust[h]) < 1e-5
        wanted = "block" if distrust[h] > 0.5 * (trust[h] + distrust[h] + rank[h]) else "allow"
        rule = next((x for x in rules if x.host == h), None)
        assert r.verdict == ("allow" if rule.allow else "block") if rule else r.verdict == wanted
        if rule is None:
            by_method[r.verdict] += 1
    assert by_method["block"] >= 8 and by_method["allow"] >= 20


def test_planted_credentials(spark):
    """Bare credentials in a format that labelled ones have: how many are found, and what else is."""
    draw = random.Random(3)
    some = lambda signs, n: "".join(draw.choices(signs, k=n))
    key = lambda: f"ZK{some('0123456789', 4)}-{some('QWERTYUP', 3)}{some('0123456789', 5)}_{some('xyzvw', 6)}"
    words = "the of windmills harbour letter nineteen-hundred state-of-the-art version-2.1 example.org/page_12 well-known 2024-05-01 A-17 follow-up".split()
    prose = lambda n: " ".join(draw.choices(words, k=n))
    docs = [(i, f"{prose(20)} password={key()} {prose(20)}") for i in range(300)]
    bare = {1000 + i: key() for i in range(100)}
    docs += [(i, f"{prose(15)} {k} {prose(15)}") for i, k in bare.items()]
    docs += [(5000 + i, prose(60)) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    formats = secretscan.fit_automata(df)
    text, found, false = dict(docs), 0, 0
    for r in secretscan.scan_secrets(df, formats).collect():
        hits = [text[r.doc_id][s["start"] : s["end"]] for s in r.added]
        found += bare.get(r.doc_id) in hits
        false += sum(h != bare.get(r.doc_id) for h in hits)
    assert found >= 90 and false <= 5
