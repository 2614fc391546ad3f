"""Links found of all links with a similarity of 0.8 and more, on a whole table, against an exact prefix join in memory."""

import collections

import pyarrow.parquet as pq
import pytest

from lodestone.llm import neardup


def all_links(texts, similarity=0.8, width=5):
    """Pairs of different texts whose bags of shingles have that weighted Jaccard similarity: copies of a shingle are
    numbered, the rarest come first, and texts that share none of their first n - ceil(0.8 n) + 1 can't reach it."""
    bags = []
    for t in texts:
        words = t.encode().split()
        plain = [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
        seen = collections.Counter()
        bag = []
        for s in plain:
            bag.append(hash((s, seen[s])))
            seen[s] += 1
        bags.append(bag)
    common = collections.Counter(x for b in bags for x in b)
    index, links = collections.defaultdict(list), set()
    for k in sorted(range(len(bags)), key=lambda k: len(bags[k])):
        bag = sorted(bags[k], key=lambda x: (common[x], x))
        whole = set(bag)
        near = set()
        for x in bag[: len(bag) + 1 - -(-len(bag) * 4 // 5)]:
            near.update(index[x])
            index[x].append(k)
        for j in near:
            both = len(whole.intersection(bags[j]))
            if len(bags[j]) >= similarity * len(bag) and both >= similarity * (len(bag) + len(bags[j]) - both):
                links.add((min(j, k), max(j, k)))
    return links


def found_and_all(spark, path):
    rows = pq.read_table(path, columns=["doc_id", "text"]).to_pylist()
    different = {}
    for r in rows:
        different.setdefault(r["text"] or "", r["doc_id"])
    texts = list(different)
    group = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.read.parquet(path)).collect()}
    links = all_links(texts)
    return sum(group[different[texts[i]]] == group[different[texts[j]]] for i, j in links), len(links)


@pytest.mark.parametrize("scale", ["sf0.01"])
def test_no_link_is_lost(spark, scale):
    found, links = found_and_all(spark, f"/root/testdata/{scale}/documents.parquet")
    assert links and found == links


if __name__ == "__main__":
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    from lodestone.session import get_session, ship

    session = get_session("recall", "local[4]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("OFF")
    ship(session)
    for scale in sys.argv[1:]:
        print(scale, found_and_all(session, f"/root/testdata/{scale}/documents.parquet"))
