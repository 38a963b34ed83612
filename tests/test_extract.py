"""Extraction from small documents."""

from pyspark.sql import functions as F

from qualityspark.functions import extract as X
from qualityspark.functions import scalars as S

EML = """<e:eml xmlns:e="urn:e" xmlns:g="urn:g" packageId="p.1.1"><dataset>
<title>Salmon &lt;counts&gt;</title>
<creator><name>Ann</name><name>Bo</name></creator><creator><name>Cy</name></creator><creator/>
<abstract>one <para>two</para> three</abstract><g:n>7</g:n>
<dataTable><entityName>t1</entityName></dataTable><otherEntity/>
<section><title>outer</title><section><title>inner</title></section></section>
</dataset></e:eml>"""


def read(spark, *selectors, body=EML):
    reader = X.DocumentReader(list(selectors))
    docs = spark.createDataFrame([("a", body), ("bad", "<a><b></a>"), ("none", None)], "pid string, body string")
    parsed = reader.attach(docs)
    columns = {
        s.name: reader.nested(s) if s.sub else reader.values(s) for s in selectors
    }
    rows = parsed.select("pid", reader.ok.alias("ok"), *[c.alias(n) for n, c in columns.items()]).collect()
    return {r.pid: r for r in rows}


def test_paths(spark):
    rows = read(
        spark,
        X.Selector("title", "/eml/dataset/title"),
        X.Selector("names", "//creator/name"),
        X.Selector("wild", "/*/dataset/abstract"),
        X.Selector("text", "//abstract/text()"),
        X.Selector("attr", "/eml/@packageId"),
        X.Selector("union", "/eml/dataset/title | //entityName"),
        X.Selector("nothing", "/eml/missing"),
    )
    a = rows["a"]
    assert a.ok and a.title == ["Salmon <counts>"] and a.names == ["Ann", "Bo", "Cy"]
    assert a.wild == ["one two three"] and a.text == ["one ", " three"] and a.attr == ["p.1.1"]
    assert a.union == ["Salmon <counts>", "t1"] and a.nothing == []
    assert not rows["bad"].ok and rows["bad"].title is None
    assert not rows["none"].ok


def test_expressions(spark):
    a = read(
        spark,
        X.Selector("count", "count(//dataset/dataTable | //dataset/otherEntity)"),
        X.Selector("root", "boolean(/*[local-name() = 'eml' or local-name() = 'x'])"),
        X.Selector("other", "boolean(/*[local-name() = 'MD_Metadata'])"),
        X.Selector("builtin", "string-length(/eml/dataset/title)"),
        X.Selector("predicate", "//creator[name='Cy']/name/text()"),
    )
    assert (a["a"]["count"], a["a"].root, a["a"].other) == (["2"], ["true"], ["false"])
    assert a["a"].builtin == ["15"] and a["a"].predicate == ["Cy"]
    assert a["bad"].builtin is None and a["bad"].predicate is None


def test_one_parse_equals_builtin_xpath(spark):
    docs = spark.createDataFrame([(EML,)], "body string")
    for path in ("//creator/name", "/eml/dataset/title", "//section/title", "//dataTable/entityName"):
        ours = X.Selector("v", path)
        reader = X.DocumentReader([ours])
        row = reader.attach(docs).select(reader.values(ours).alias("v"), F.xpath("body", F.lit(path + "/text()")).alias("x")).first()
        assert row.v == row.x


def test_namespaces(spark):
    bind = {"q": "urn:g", "p": "urn:e"}
    a = read(
        spark,
        X.Selector("own", "/p:eml/dataset/q:n", namespace_aware=True, namespaces=bind),
        X.Selector("declared", "//g:n", namespace_aware=True),
        X.Selector("overridden", "//g:n", namespace_aware=True, namespaces={"g": "urn:x"}),
        X.Selector("unaware", "//n"),
    )["a"]
    assert a.own == ["7"] and a.declared == ["7"] and a.overridden == [] and a.unaware == ["7"]


def test_sub_selector(spark):
    rows = read(
        spark,
        X.Selector("names", "//creator", sub=X.SubSelector("name", "name")),
        X.Selector("titles", "//section", sub=X.SubSelector("title", "title")),
        X.Selector("below", "//section", sub=X.SubSelector("title", ".//title")),
        X.Selector("no", "//missing", sub=X.SubSelector("name", "name")),
    )
    assert rows["a"].names == [["Ann", "Bo"], ["Cy"], []]
    assert rows["a"].titles == [["outer"], ["inner"]]
    assert rows["a"].below == [["outer", "inner"], ["inner"]]
    assert rows["a"].no == []


def test_deep_document_does_not_overflow(spark):
    n = 5000
    body = "<a>" * n + "x" + "</a>" * n
    s = X.Selector("v", "count(//a)")
    assert read(spark, s, body=body)["a"].v == [str(n)]


def test_retype(spark):
    cases = {
        "2": ("number", 2.0), "1.5": ("number", 1.5), "-3e2": ("number", -300.0), "0x1F": ("number", 31.0), "7L": ("number", 7.0),
        "0.5": ("number", 0.5), "0": ("string", "0"), "007": ("string", "007"), "Yes": ("boolean", True), "OFF": ("boolean", False),
        "true": ("boolean", True), "Y": ("string", "Y"), "hello": ("string", "hello"), "": ("string", ""), "1.2.3": ("string", "1.2.3"),
        "NaN": ("string", "NaN"), "+1": ("string", "+1"),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.expr(S.retype_sql("t")).alias("v")).collect()
    for r in rows:
        kind, value = cases[r.t]
        got = {"number": r.v.num, "boolean": r.v.bool, "string": r.v.str}[r.v.kind]
        assert (r.v.kind, got) == (kind, value), r.t


JSON = (
    '{"@context":["https://schema.org/"],"name":"hello","n":5,"keywords":["a","b",3,{"z":1,"a":2}],'
    '"creator":{"@list":[{"name":"x"},{"name":"y"}]},"flag":"yes"}'
)


def test_json_paths(spark):
    docs = spark.createDataFrame([(1, JSON), (2, "not json")], "i int, body string")
    paths = {
        "name": ".name", "n": ".n", "each": ".keywords[]", "whole": ".keywords", "list": '.creator["@list"][].name',
        "ctx": '.["@context"] | .[0]', "flag": ".flag", "none": ".missing", "nothing": ".missing[]",
    }
    r, bad = X.with_json_values(docs, "body", paths).orderBy("i").collect()
    assert r.name.str == "hello" and r.n.kind is None and r.flag.bool is True
    assert r.each["kind"] == "list" and r.each["items"] == ["a", "b", None, '{"z":1,"a":2}']
    assert r.whole.str == '["a","b",3,{"z":1,"a":2}]' and r["list"]["items"] == ["x", "y"]
    assert r.ctx.str == "https://schema.org/" and r.none.kind is None
    assert r.nothing["kind"] == "list" and r.nothing["items"] == []
    assert bad.name.kind is None
    assert X.with_json_values(docs, "body", {"n": ".n"}, scalars=True).orderBy("i").first().n.num == 5.0


def test_node_table(spark):
    docs = spark.createDataFrame([("a", EML), ("bad", "<a>")], "pid string, body string")
    nodes = X.shred(docs)
    assert nodes.filter("pid = 'bad'").count() == 0
    n = {r.path: r for r in nodes.filter("local IN ('eml', 'n')").collect()}
    assert n["/eml"].parent_id is None and n["/eml"].ns_uri == "urn:e" and n["/eml"].attrs == {"packageId": "p.1.1"}
    assert n["/eml/dataset/n"].prefix == "g" and n["/eml/dataset/n"].text == "7"
    assert {(r.ns_uri, r.prefix) for r in X.namespaces_of(docs).collect()} == {("urn:e", "e"), ("urn:g", "g")}
    assert [(r.local, r.ns_uri) for r in X.root_namespace(docs).collect()] == [("eml", "urn:e")]


def test_schema_check(spark, tmp_path):
    xsd = tmp_path / "doc.xsd"
    xsd.write_text(
        '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="doc"><xs:complexType><xs:sequence>'
        '<xs:element name="n" type="xs:int"/></xs:sequence></xs:complexType></xs:element></xs:schema>'
    )
    docs = spark.createDataFrame([(1, "<doc><n>1</n></doc>"), (2, "<doc><m>1</m></doc>"), (3, None)], "i int, body string")
    checked = docs.select("i", X.schema_check(F.col("body"), "n string, _corrupt string", str(xsd)).alias("c")).orderBy("i")
    assert [r.c.status for r in checked.collect()] == ["SUCCESS", "FAILURE", "ERROR"]


def test_scalars_of_one_parse(spark):
    body = """<a><b>1</b><b> two, 'three' </b><c/><d x="y">é</d></a>"""
    exprs = {
        "more": "count(//b) > 1", "same": "//b = '1'", "half": "count(//b) div 4", "none": "number(//b[2])", "text": "string(//b[2])", "empty": "string(//c)",
        "joined": "concat(//d, ', ', //d/@x)", "literal": "'a, b'", "mark": "concat('\x01', //b[1])", "last": "string(//c)",
    }
    rows = read(spark, *[X.Selector(n, x) for n, x in exprs.items()], body=body)
    found = {n: rows["a"][n] for n in exprs}
    assert found == {
        "more": ["true"], "same": ["true"], "half": ["0.5"], "none": ["NaN"], "text": [" two, 'three' "], "empty": [""],
        "joined": ["é, y"], "literal": ["a, b"], "mark": ["\x011"], "last": [""],
    }
    assert all(rows["bad"][n] is None and rows["none"][n] is None for n in exprs)
    # However many there are, the JVM parses once; one with the mark in it is by itself.
    reader = X.DocumentReader([X.Selector(n, x) for n, x in exprs.items()])
    docs = reader.attach(spark.createDataFrame([("a", body)], "pid string, body string"))
    plan = docs.select(*[reader.values(X.Selector(n, x)).alias(n) for n, x in exprs.items()])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("XPathStringEvaluator(") == 2, plan


def test_work_of_node_sets():
    """Nodes are made where an expression leads, siblings are not gone through once per sibling."""
    import time
    from xml.etree import ElementTree

    from qualityspark.functions import xpaths

    n = 20_000
    root = ElementTree.fromstring("<r><s><k v='1'>a</k></s>" + "<x><y>b</y> </x>" * n + "</r>")
    top = xpaths.tree(root)
    at = lambda x: xpaths.Evaluator(top, None).nodes(xpaths.parse(x))
    assert [k.text() for k in at("//s/k[@v='1']")] == ["a"] and len(top.tree._made) < 10
    begun = time.perf_counter()
    assert len(at("//x/following-sibling::x")) == n - 1 and len(at("//x/preceding-sibling::x")) == n - 1
    assert len(at("//x/following-sibling::x[1]")) == n - 1 and len(at("//x[position() = 2]")) == 1 and len(at("//x[last()]")) == 1
    assert len(at("//y[. = /r/x[1]/y]")) == n and len(at("//x//y | //y/ancestor::x")) == 2 * n
    assert [t.text() for t in at("//s/following-sibling::node()[2]/text()")] == [" "]
    assert time.perf_counter() - begun < 20
