from terravane.llm import set_join as sj


def test_near_copies_with_null_ids(spark):
    """8 and 9 link only through a near copy that has a null id; two others with null ids link with each other alone."""
    w = [f"w{i}" for i in range(60)]
    ends = lambda n: " ".join([*(f"l{i}" for i in range(n)), *w[n : 60 - n], *(f"r{i}" for i in range(n))])
    rows = [(8, " ".join(w[:52])), (9, " ".join(w[8:])), (None, " ".join(w)), (None, "one two three four five six seven eight nine ten eleven twelve thirteen"), (None, "one two three four five six seven eight nine ten eleven twelve"), (10, ends(20)), (None, ""), (None, None)]
    one, two = (set(zip(*(t.split()[k:] for k in range(5)))) for t in (rows[0][1], rows[1][1]))
    assert 100 * len(one & two) < 75 * len(one | two)
    got = sj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted([(8, 48, 8), (9, 48, 8), (None, 56, 8), (None, 9, None), (None, 8, None), (10, 56, 10), (None, 0, None), (None, 0, None)], key=key)
