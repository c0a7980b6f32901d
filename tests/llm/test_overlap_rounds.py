"""What SimHash joins is left out of the exact search that follows it."""

import random

from emberlog.llm import common, overlap

from .test_overlap import SCHEMA, brute


def test_simhash_comes_first_and_what_it_joins_is_not_tried_again(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for size, edits in ((600, 1), (600, 1), (120, 3)):
        base = rng.choices(words, k=size)
        for _ in range(16):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(size)] = rng.choice(words)
            rows.append((len(rows) + 1, " ".join(w), "x"))
    df, want = spark.createDataFrame(rows, SCHEMA), brute([r[:2] for r in rows])
    table_of, links = common.table_of, overlap.links
    seen, sims = [], {}

    def spy(frame):
        out, forget = table_of(frame)
        if out.columns in (["a", "b"], ["node", "root"]):
            seen.append((out.columns[0], [tuple(r) for r in out.collect()]))
        return out, forget

    def run(prefixes_of):
        monkeypatch.setattr(overlap, "links", lambda p, sets_of, share: links(prefixes_of(p), sets_of, share))
        assert {r.doc_id: r.component_id for r in overlap.near_duplicates(df).collect()} == want
        at = next(i for i, (kind, _) in enumerate(seen) if kind == "node")
        return seen[0][1], dict(seen[at][1]), seen[at + 1][1]

    def noted(p):
        sims.update({r.fp: r.sim for r in p.select("fp", "sim").collect()})
        return p

    monkeypatch.setattr(common, "table_of", spy)
    first, root, after = run(noted)
    names = sorted(sims)
    group = {x: x for x in names}
    for i, a in enumerate(names):
        for b in names[:i]:
            if ((sims[a] ^ sims[b]) % (1 << 64)).bit_count() <= 2:
                old, new = group[a], group[b]
                group.update({x: new for x in names if group[x] == old})
    assert first and all(group[a] == group[b] for a, b in first)
    assert root and all(root.get(a, a) != root.get(b, b) for a, b in after)
