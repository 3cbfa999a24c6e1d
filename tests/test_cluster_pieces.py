"""Pieces of the as-of clusters that share a call."""

import pandas as pd

from attestra.operators import clusters

_COLUMNS = ["comp", "rng", "seq", "t", "a", "b", "x", "y"]


def _rows(comp, rng, *events):
    return pd.DataFrame([(comp, rng, *e) for e in events], columns=_COLUMNS).astype("int64")


def _listed(df):
    return sorted(tuple(None if pd.isna(v) else v for v in r) for r in df.astype(object).itertuples(index=False))


def test_pieces_of_one_component_share_a_call_and_nothing_else():
    """Both pieces know nodes 1 and 2; a link, a size or a block of one piece must not reach the other."""
    first = _rows(7, 2, (0, 2, 1, 1, 1, 0), (5, 1, 1, 2, 8, 0), (5, 2, 2, 2, 0, 0), (9, 2, 1, 1, 0, 0))
    second = _rows(7, 3, (4, 0, 1, 3, -1, -1), (20, 2, 2, 2, 0, 0), (20, 2, 1, 1, 0, 0), (25, 1, 2, 3, 2, 0), (26, 2, 3, 3, 0, 0))
    together = clusters._replay(pd.concat([second, first], ignore_index=True))
    assert _listed(together) == sorted(_listed(clusters._replay(first)) + _listed(clusters._replay(second)))
    answers = {(r.seq, r.vid): (r.cluster_size, r.kind_mask, r.linked_blocked)
               for r in together[together["parent"].isna()].itertuples()}
    assert answers == {(0, 1): (1, 0, False), (5, 2): (2, 8, True), (9, 1): (2, 8, False),
                       (20, 2): (1, 0, False), (20, 1): (3, 4, False), (26, 3): (2, 2, False)}


def test_whole_components_list_all_ancestors():
    links = [(i, 1, i, i + 1, 1, 0) for i in range(1, 30)]
    forest = clusters._replay(_rows(3, 1, *links))
    up = {(r.vid, r.parent) for r in forest.itertuples()}
    assert forest["all_above"].all() and len(up) == len(forest)
    assert all((a, c) in up for a, b in up for b2, c in up if b == b2)
