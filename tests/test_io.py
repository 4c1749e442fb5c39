"""Readers, writers, settings, the command line and streams."""

import pytest
from fixtures import L4, L6, graph
from pyspark.sql import functions as F

from graphloom import cli, config, graph as g
from graphloom.functions.delimiters import decode
from graphloom.functions.ipv4 import ipv4_to_long, long_to_ipv4
from graphloom.operators import louvain
from graphloom.sinks import text
from graphloom.sources import community_text, edge_text
from graphloom.streaming import edges as streams


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def fails(df):
    with pytest.raises(Exception, match="USER_RAISED_EXCEPTION"):
        df.collect()


# ---------------------------------------------------------------- sources
def test_strict_edges(spark):
    assert rows(edge_text.strict_edges(lines(spark, "1,2", " a , b ,7", "x,y,,", "p,q,-3"))) == [("1", "2", 1), ("a", "b", 7), ("x", "y", 1), ("p", "q", -3)]
    assert rows(edge_text.strict_edges(lines(spark, "1 \t2\t10"), "\t")) == [("1", "2", 10)]
    assert rows(edge_text.strict_edges(lines(spark, "1\x012"), "\\x01")) == [("1", "2", 1)]
    assert rows(edge_text.strict_edges(lines(spark, "1::2:3"), ":+")) == [("1", "2", 3)]
    for bad in ("1", "", "1,2,3,4", "1,2,x", "1,2,9223372036854775808"):
        fails(edge_text.strict_edges(lines(spark, bad)))
    assert edge_text.strict_edges(lines(spark, "1,2").limit(0)).count() == 0


def test_numeric_edges(spark):
    assert rows(edge_text.numeric_edges(lines(spark, "1,2", "3,4,5"))) == [(1, 2, 1), (3, 4, 5)]
    assert rows(edge_text.numeric_edges(lines(spark, "0.0.1.0,10.0.0.1"), convert=ipv4_to_long)) == [(256, 167772161, 1)]
    fails(edge_text.numeric_edges(lines(spark, "a,2")))


def test_tokenized_edges(spark):
    def one(line, **kw):
        return rows(edge_text.tokenized_edges(lines(spark, line), **kw))

    assert one("north,south") == [("north", "south", 1)]
    assert one("k1\tk2\t-31", delimiter="\t") == [("k1", "k2", -31)]
    assert one("pier\\7, quay 8 ,12") == [("pier\\7", " quay 8 ", 12)]
    assert one("pier:quay:left:right", delimiter=":", value="text") == [("pier", "quay", "left")]
    assert one("pier,quay,88", value="text", ignore_value=True) == [("pier", "quay", "")]
    assert one("p,q,3,rest,of,the,line") == [("p", "q", 3)]
    assert one("1mn2nnm3m", delimiter="mn", value="text") == [("1", "2", "3")]
    assert one(",,1,,2,,", default="5", reverse=True) == [("1", "2", 5), ("2", "1", 5)]
    for bad in ("lonely", "lonely,", ",lonely", ",", ""):
        fails(edge_text.tokenized_edges(lines(spark, bad)))
        fails(edge_text.tokenized_edges(lines(spark, bad), value="text"))
    fails(edge_text.tokenized_edges(lines(spark, "p,q,heavy")))


def test_dictionaries(spark, tmp_path):
    edges = spark.createDataFrame([("b", "a", 1), ("b", "c", 2), ("é", "a", 1)], "src string, dst string, weight bigint")
    names = g.node_dictionary(edges)
    assert {r.name: r.id for r in names.collect()} == {"a": 0, "b": 1, "c": 2, "é": 3}
    assert sorted(rows(g.encode(edges, names, 3))) == [(1, 0, 1), (1, 2, 2), (3, 0, 1)]
    (tmp_path / "e.tsv").write_text("z\ty\t4\ny\tx\nbad\nw\tz\n")
    names, found = edge_text.first_seen_dictionary(spark, str(tmp_path / "e.tsv"))
    assert {r.name: r.id for r in names.collect()} == {"z": 0, "y": 1, "x": 2, "w": 3}
    assert sorted(rows(found)) == [("w", "z"), ("y", "x"), ("z", "y")]


def test_community_rows(spark):
    got = community_text.community_rows(lines(spark, "a\t5\tb:2,c:3,b:1", "b\t0"))
    assert rows(got) == [("a", 5, "b:2,c:3,b:1"), ("b", 0, None)]
    more = got.unionByName(spark.createDataFrame([("c", None, ",d,,e:4,"), ("d", 1, "")], got.schema))
    vertices, edges = community_text.community_states(more)
    assert sorted(rows(edges)) == [("a", "b", 3), ("a", "c", 3), ("c", "d", 1), ("c", "e", 4)]
    assert {r.id: (r.internalWeight, r.nodeWeight, r.communitySigmaTot) for r in vertices.collect()} == {"a": (5, 6, 11), "b": (0, 0, 0), "c": (0, 5, 5), "d": (1, 0, 1)}
    fails(community_text.community_rows(lines(spark, "a")))


def test_ipv4(spark):
    df = lines(spark, "1.2.3.4", "255.255.255.255", "0.0.0.0", "256.1.1.1", "1.2.3", "", "01.2.3.4").withColumn("n", ipv4_to_long("value"))
    got = {r.value: (r.n, r.back) for r in df.withColumn("back", long_to_ipv4("n")).collect()}
    assert got["1.2.3.4"] == (16909060, "1.2.3.4") and got["255.255.255.255"] == (2**32 - 1, "255.255.255.255") and got["0.0.0.0"] == (0, "0.0.0.0")
    assert all(got[x] == (None, None) for x in ("256.1.1.1", "1.2.3", "", "01.2.3.4"))
    fails(lines(spark, "x").select(ipv4_to_long("value", strict=True)))


def test_delimiters():
    assert [decode(x) for x in (",", "\\x01", "\\t", "||")] == [",", "\x01", "\t", "||"]


# ---------------------------------------------------------------- sinks
def test_edge_sinks(spark):
    edges = spark.createDataFrame([("34", "12", "1"), ("34", "6", "4")], "src string, dst string, value string")
    nodes = spark.createDataFrame([("34", "10.43433333389")], "id string, value string")
    assert sorted(rows(text.configurable_edge_lines(edges, nodes, ",", True, True))) == [("34,12,10.43433333389,1",), ("34,6,10.43433333389,4",)]
    assert rows(text.configurable_edge_lines(edges, None, ":", False, True)) == [("34:12:1",), ("34:6:4",)]
    assert rows(text.configurable_edge_lines(edges)) == [("34,12",), ("34,6",)]
    assert rows(text.edge_lines(edges, "|")) == [("34|12",), ("34|6",)]
    labels = spark.createDataFrame([("34", "99")], "id string, component string")
    assert sorted(rows(text.component_lines(edges, labels))) == [("34,12,99",), ("34,6,99",)]
    scores = spark.createDataFrame([("1", 0.0), ("2", 1.0)], "id string, betweenness double")
    assert rows(text.tab_vertex_lines(scores, "betweenness")) == [("1\t0.0",), ("2\t1.0",)]


def test_community_sinks(spark):
    vertices = spark.createDataFrame([("1", "c", 3), ("2", "c", 0)], "id string, community string, internalWeight bigint")
    edges = spark.createDataFrame([("1", "x", 2), ("1", "b", 5)], "src string, dst string, weight bigint")
    assert sorted(rows(text.community_vertex_lines(vertices, edges))) == [("1\tc\t3\tb:5,x:2",), ("2\tc\t0",)]
    found = spark.createDataFrame([(1, 4, 2, 8, 9, True)], "src int, src_community int, dst int, dst_community int, component int, crosses boolean")
    assert rows(text.neighbor_lines(found, ",", ":")) == [("1:4,2:8,9,true",)]


# ---------------------------------------------------------------- settings and command line
XML = """<configuration><system><property><name>a</name><value>1</value></property></system>
<custom><property><name>b</name><value>2</value></property></custom><giraph><property><name>w</name><value>3</value></property></giraph></configuration>"""


def test_settings():
    file = config.parse_xml(XML)
    assert (file.system, file.custom, file.engine) == ({"a": "1"}, {"b": "2"}, {"w": "3"})
    both = config.layered(config.Settings(custom={"b": "0", "c": "9"}), file, config.Settings(custom={"b": "7"}))
    assert both.custom == {"b": "7", "c": "9"} and both.system == {"a": "1"}
    for bad in ("<configuration><system><property><name>a</name></property></system></configuration>", "<x"):
        with pytest.raises(ValueError):
            config.parse_xml(bad)
    assert config.pairs(["a=b=c", "d=\\t", "e="]) == {"a": "b=c", "d": "\t", "e": ""}
    with pytest.raises(ValueError):
        config.pairs(["nothing"])


def test_arguments():
    a = cli.parse(["wccGraphX", "-i", "in", "-o", "out"])
    assert (a.analytic, a.delimiter, a.kryo, a.name) == ("wcc_min", ",", False, "Graph Analytic")
    for bad in (["wcc", "-i", "in"], ["nothing", "-i", "in", "-o", "out"], []):
        with pytest.raises(ValueError):
            cli.parse(bad)


@pytest.mark.parametrize("analytic", ["wcc", "lc", "louvain", "text:wcc", "text:louvain", "hbse"])
def test_command_line_runs(spark, tmp_path, analytic):
    source = tmp_path / "edges.csv"
    source.write_text("\n".join((L6 if analytic == "text:louvain" else L4).split()) + "\n")
    args = cli.parse([analytic, "-i", str(source), "-o", str(tmp_path / "out"), "--ca", "vertex.count=100"])
    out = cli.run(spark, args)

    def read(part=""):
        return [r.value for r in spark.read.text(f"{out}{part}").collect()]

    if analytic == "wcc":
        assert len(read()) == 17 and all(x.endswith(",9") for x in read())
    elif analytic == "lc":
        assert read() == []
    elif analytic == "louvain":
        assert len(read("/level_0_vertices")) == 9 and read("/qvalues_0")[0].startswith("(0,0.41349480968858")
        assert any(x.startswith("(1,{name:1,community:4,communityName:4,communitySigmaTot:21") for x in read("/level_0_vertices"))
    elif analytic == "text:wcc":
        assert len(read()) == 17 and all(x.count(",") == 2 for x in read())
    elif analytic == "text:louvain":
        assert {x.split("\t")[1] for x in read("/stage_0")} == {"2"}
    else:
        assert len(read()) == 9 and len(read("highBetweennessSetData")) == 9


# ---------------------------------------------------------------- streams
def test_streamed_edges(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("1,2,5\n2,3\n")
    (folder / "b.csv").write_text("1,2,7\n")
    query = streams.running_weights(streams.stream_edges(streams.stream_lines(spark, str(folder), 1)))
    run = query.writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(rows(spark.table("running"))) == [("1", "2", 12, 2), ("2", "3", 1, 1)]


def test_windowed_weights(spark):
    at = F.to_timestamp(F.lit("2024-01-01 10:20:00"))
    edges = graph(spark, "1,2,3 1,2,4").withColumn("seen_at", at)
    assert rows(streams.windowed_weights(edges).select("src", "dst", "weight", "n")) == [(1, 2, 7, 2)]


# ---------------------------------------------------------------- the registry
def test_registry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and {"wcc_max", "p2_found", "p4_found", "p5_found"} <= set(names)


def test_labels_of_levels(spark):
    found = louvain.louvain(graph(spark, L4))
    assert {r.id: r.community for r in found.labels().collect()}[9] == 8
