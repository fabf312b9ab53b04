from vellumine.operators.flatten import flat_table, json_nodes


def test_nodes_and_flat_tables(spark):
    rows = [
        (1, '{"a": {"b": [{"n": "1"}, {"n": 2, "t": ["u"]}]}}', "z"),
        (2, '"[{\\"k\\": {}}]"', "z"),
        (3, '{"a": ', "z"),
        (4, "", "z"),
        (5, None, "z"),
        (None, '{"o": {}}', None),
        (1, '{"a": {"b": [{"n": "1"}, {"n": 2, "t": ["u"]}]}}', "z"),
        (7, '{"big": "' + "x" * 3_000_000 + '", "o": {"p": "{\\"q\\": {}}"}}', "z"),
    ]
    df = spark.createDataFrame(rows, "id long, body string, node_path string")
    nodes = json_nodes(df, "id", "body", fields=True)
    got = sorted(((x.record_id, x.node_path, x.parent_path) for x in nodes.select("record_id", "node_path", "parent_path").distinct().collect()), key=str)
    assert got == sorted(
        [(1, "", None), (1, "a", ""), (1, "a.b[0]", "a"), (1, "a.b[1]", "a"), (2, "[0]", ""), (2, "[0].k", "[0]"), (None, "", None), (None, "o", ""), (7, "", None), (7, "o", ""), (7, "o.p", "o"), (7, "o.p.q", "o.p")],
        key=str,
    )
    flat = flat_table(nodes, "a.b[]", {"n": "int", "t[0]": "string"}).distinct().orderBy("place").collect()
    assert [tuple(x) for x in flat] == [(1, "a.b[0]", "a", 0, 1, None), (1, "a.b[1]", "a", 1, 2, "u")]
    assert json_nodes(df.limit(0), "id", "body").count() == 0
