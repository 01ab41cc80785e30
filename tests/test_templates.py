"""Mined templates against one tree over each service's texts in the order of first sight."""

import random

import pytest

from tidemark.operators import templates as M


def one_tree(rows, room):
    """text -> (id, template) of a service's texts, placed one after the other."""
    nodes, placed, names = {}, {}, []
    for text in [t for _, t in sorted(rows)]:
        tokens = text.split()
        node = nodes.setdefault(len(tokens), {})
        step = tokens[0] if tokens else ""
        step = M.WILD if any(c.isdigit() for c in step) else step
        if step not in node and len(node) >= room:
            step = M.WILD
        leaf = node.setdefault(step, M.Leaf())
        at = leaf.add(tokens)
        if (id(leaf), at) not in names:
            names.append((id(leaf), at))
        placed[text] = (leaf, at, names.index((id(leaf), at)) + 1)
    return {t: (n, " ".join(leaf.templates[at])) for t, (leaf, at, n) in placed.items()}


@pytest.mark.parametrize("room", [100, 4])
def test_equal_to_one_tree_whatever_the_partitions(spark, room):
    rnd = random.Random(8)
    words = "user job cache disk link node open closed failed sent 1st x2".split()
    rows = [(s, " ".join(rnd.choices(words, k=rnd.randrange(0, 6))), i) for s in ("a", "b") for i in range(900)]
    rows += rows[:50]
    want = {}
    for s in ("a", "b"):
        first = {}
        for service, text, i in rows:
            if service == s:
                first[text] = min(i, first.get(text, i))
        want |= {(s, t): v for t, v in one_tree([(i, t) for t, i in first.items()], room).items()}
    for parts in (1, 7):
        got = M.mined(spark.createDataFrame(rows, "service string, text string, first_seen long").repartition(parts), room).collect()
        assert {(r.service, r.text): (int(r.template_id.split(":T")[1]), r.template) for r in got} == want and len(got) == len(want)


def test_a_second_text_generalises_under_the_same_id(spark):
    rows = [("gate", "Door north opened by <*>", 1), ("gate", "Door south opened by <*>", 2), ("gate", "Lamp off", 3)]
    got = {r.text: (r.template_id, r.template) for r in M.mined(spark.createDataFrame(rows, "service string, text string, first_seen long")).collect()}
    assert got["Door north opened by <*>"] == got["Door south opened by <*>"] == ("gate:T00001", "Door <*> opened by <*>") and got["Lamp off"] == ("gate:T00002", "Lamp off")
    assert M.mined(spark.createDataFrame(rows, "service string, text string, first_seen long").limit(0)).collect() == []
