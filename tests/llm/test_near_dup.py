"""Near duplicates: how members of large buckets are dealt to blocks."""

import numpy as np

from corpusloom.llm import near_dup


def test_members_of_buckets_know_their_sizes_without_a_join(spark, monkeypatch):
    own, plans, members, dealt = near_dup._in_blocks, [], [], []

    def seen(left, p):
        cut = own(left, p)
        plans.extend(df._jdf.queryExecution().optimizedPlan().toString() for df in (left, cut))
        members.extend(left.collect())
        dealt.extend(cut.collect())
        return cut

    monkeypatch.setattr(near_dup, "_in_blocks", seen)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" if rng.random() > 0.02 else f"x{rng.integers(10**9)}" for i in range(60)) for _ in range(120)]
    near_dup.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), near_dup.Params(block_bytes=16_000)).count()
    assert "Join" not in plans[0] and plans[1].count("Join") == 1
    assert min(r.n for r in members) > 0
    assert len({(r.key, r.rid, r.bi, r.bj) for r in dealt}) == len(dealt) and all(r.mine in (r.bi, r.bj) for r in dealt)
    blocks = {}
    for r in dealt:
        blocks.setdefault((r.key, r.bi, r.bj), []).append(r)
    met = {(k[0], *sorted((a.rid, b.rid))) for k, v in blocks.items() for a in v for b in v if a.comp != b.comp}
    assert met == {(a.key, *sorted((a.rid, b.rid))) for a in members for b in members if a.key == b.key and a.comp != b.comp}
