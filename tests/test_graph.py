"""Graph operators on small graphs with known answers, and against a plain evaluator."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import terms as T
from quillgraph.operators import ontology, paths, tables, temporal, vector
from quillgraph.operators.graph import Graph, delete, insert, verify
from quillgraph.operators.solutions import Solutions, count, extreme, mean, total
from quillgraph.plans.store import Store
from quillgraph.sources import formats
from quillgraph.streaming import ingest


def e(x):
    return f"<http://example.org/{x}>"


def graph(spark, rows):
    return Graph(spark.createDataFrame(rows, "s string, p string, o string"))


def papers():
    year = {"attention": 2017, "bert": 2018, "gpt": 2020, "cooking": 2019, "gardening": 2021}
    vec = {"attention": "0.9 0.1 0 0", "bert": "0.85 0.15 0 0", "gpt": "0.8 0.2 0 0", "cooking": "0 0 0.9 0.1", "gardening": "0 0 0.1 0.9"}
    rows = [(e(x), T.RDF_TYPE, e("Paper")) for x in year] + [(e(x), T.RDF_TYPE, e("Person")) for x in ("vaswani", "devlin")]
    rows += [(e(x), e("year"), T.literal(y)) for x, y in year.items()] + [(e(x), e("title"), T.literal(x.title())) for x in year]
    rows += [(e("attention"), e("author"), e("vaswani")), (e("bert"), e("author"), e("devlin"))]
    rows += [(e(a), e("cites"), e(b)) for a, b in (("bert", "attention"), ("gpt", "attention"), ("gpt", "bert"))]
    return rows + [(e(x), e("emb"), T.literal(v, "http://ex.org/f32vec")) for x, v in vec.items()]


@pytest.fixture(scope="module")
def g(spark):
    return graph(spark, papers())


def names(solutions, v):
    return sorted(r[v][20:-1] for r in solutions.df.collect())


def test_vectors(g):
    v = g.vectors(e("emb"))
    near = vector.search(v, [0.9, 0.1, 0, 0], threshold=0.7, subject="x")
    assert names(near, "x") == ["attention", "bert", "gpt"]
    assert names(vector.search(v, [0, 0, 0.95, 0.05], threshold=0.9, subject="x"), "x") == ["cooking"]
    assert names(near.join(g.match("?x", e("year"), "?y")).filter(T.less(F.lit(T.literal(2018)), F.col("y"))), "x") == ["gpt"]
    assert vector.search(v, [0.5] * 4, threshold=0.99).df.count() == 0
    assert vector.search(v, [0.9, 0.1, 0, 0], k=2, threshold=0.0).df.count() == 2
    with_author = near.optional(g.match("?x", e("author"), "?a"))
    assert with_author.df.count() == 3 and with_author.df.where("a IS NOT NULL").count() == 2
    bound = vector.filter_similar(g.match("?x", e("cites"), "?y"), v, [0.9, 0.1, 0, 0], "x", threshold=0.7)
    assert names(bound, "x") == ["bert", "gpt", "gpt"]
    with pytest.raises(KeyError):
        g_without = Graph(tables=[])
        g_without.vectors(e("emb"))


def test_patterns(g):
    paper, person = (g.match("?x", T.RDF_TYPE, e(c)) for c in ("Paper", "Person"))
    assert paper.union(person).df.count() == 7
    assert g.match("?x", e("author"), "?o").union(g.match("?x", e("cites"), "?o")).df.count() == 5
    years = [r["y"] for r in g.match("?x", e("year"), "?y").order_by("-y").native(y="int").collect()]
    assert years == [2021, 2020, 2019, 2018, 2017]
    assert g.bgp(("?x", e("cites"), "?y"), ("?y", e("author"), e("vaswani")), ("?x", e("title"), "?t")).df.count() == 2
    assert g.match("?x", e("cites"), "?c").select("c", distinct=True).df.count() == 2
    assert g.match("?x", e("year"), "?y").order_by("y").slice(2, 1).df.count() == 2
    assert names(paper.exists(g.match("?x", e("cites"), "?c")), "x") == ["bert", "gpt"]
    assert names(paper.not_exists(g.match("?x", e("cites"), "?c")), "x") == ["attention", "cooking", "gardening"]
    assert paper.values("x", [e("bert"), e("nobody")]).df.count() == 1
    with pytest.raises(ValueError):
        paper.join(g.match("?z", e("author"), "?a"))
    assert g.match("?x", "?p", "?x").df.count() == 0
    assert [r["result"] for r in paper.ask().collect()] == [True]
    assert g.match("?x", e("cites"), "?y").construct(("?y", e("citedBy"), "?x"), ("?x", T.RDF_TYPE, e("Citing"))).count() == 5
    assert g.describe(e("bert")).count() == 7
    assert [r["result"] for r in g.contains(e("bert"), e("cites"), e("attention")).collect()] == [True]


def test_groups(spark):
    rows = [(e(k), e("v"), T.literal(v)) for k, v in (("a", 3), ("b", -5), ("c", 2.5), ("d", "text"))]
    s = graph(spark, rows).match("?x", e("v"), "?v")
    r = s.group(n=count(), s=total("v"), m=mean("v"), lo=extreme("v"), hi=extreme("v", largest=True)).df.first()
    assert (r["n"], r["s"], round(r["m"], 6), r["lo"], r["hi"]) == (4, 0.5, round(0.5 / 3, 6), T.literal("text"), T.literal(3))
    empty = s.filter(F.lit(False)).group(n=count(), s=total("v"), lo=extreme("v")).df.first()
    assert tuple(empty) == (0, 0.0, None)
    assert [T.literal(-5), T.literal(2.5), T.literal(3)] == [r["v"] for r in s.filter(T.num(F.col("v")).isNotNull()).order_by("v").df.collect()]


def plain_join(a, b):
    out = []
    for x in a:
        for y in b:
            if all(x[k] == y[k] for k in set(x) & set(y)):
                out.append(x | y)
    return out


def test_joins_with_unbound_variables_against_a_plain_evaluator(spark):
    rng = random.Random(4)
    for trial in range(3):
        bags = []
        for variables in (("a", "b"), ("b", "c"), ("a", "c")):
            bags.append([{v: str(rng.randrange(3)) for v in variables if rng.random() < 0.75} for _ in range(7)])
        made = [Solutions(spark.createDataFrame([tuple(m.get(v) for v in vs) for m in bag], ", ".join(f"{v} string" for v in vs)), vs) for bag, vs in zip(bags, (("a", "b"), ("b", "c"), ("a", "c")))]
        key = lambda m: sorted((k, v) for k, v in m.items() if v is not None)
        got = made[0].join(made[1]).join(made[2]).df.collect()
        assert sorted(key(r.asDict()) for r in got) == sorted(key(m) for m in plain_join(plain_join(bags[0], bags[1]), bags[2])), trial
        left = made[0].optional(made[1]).df.collect()
        want = [m for x in bags[0] for m in (plain_join([x], bags[1]) or [x])]
        assert sorted(key(r.asDict()) for r in left) == sorted(map(key, want))
        assert made[0].exists(made[1]).df.count() == sum(bool(plain_join([x], bags[1])) for x in bags[0])


def test_self_join_star_and_grid(spark):
    leaves = [(e(f"leaf/{i}"), e("category"), e(f"cat/{i % 5}")) for i in range(200)]
    g = graph(spark, leaves)
    s = g.match("?a", e("category"), "?c").join(g.match("?b", e("category"), "?c")).filter(F.col("a") != F.col("b"))
    assert s.df.count() == 5 * 40 * 39
    right = [(e(f"{x}_{y}"), e("right"), e(f"{x + 1}_{y}")) for x in range(19) for y in range(20)]
    assert paths.sequence(*[graph(spark, right).relation(e("right"))] * 2).count() == 360


def closure(edges):
    out = set(edges)
    while True:
        new = {(a, d) for a, b in out for c, d in edges if b == c} - out
        if not new:
            return out
        out |= new


def test_paths_against_closure(spark):
    rng = random.Random(8)
    edges = {(str(rng.randrange(12)), str(rng.randrange(12))) for _ in range(14)} | {("a", "b"), ("b", "c"), ("c", "a")}
    df = spark.createDataFrame(list(edges), "s string, o string")
    plus, nodes = closure(edges), {x for p in edges for x in p}
    pairs = lambda d: sorted((r["s"], r["o"]) for r in d.collect())
    assert pairs(paths.one_or_more(df)) == sorted(plus)
    assert pairs(paths.zero_or_more(df)) == sorted(plus | {(n, n) for n in nodes})
    assert pairs(paths.zero_or_one(df)) == sorted(edges | {(n, n) for n in nodes})
    start = spark.createDataFrame([("a",)], "s string")
    assert pairs(paths.one_or_more(df, start)) == sorted(p for p in plus if p[0] == "a")
    assert pairs(paths.one_or_more(df, start, until=F.col("o") == "b")) == [("a", "b")]
    assert pairs(paths.one_or_more(df, start, depth=2)) == [("a", "b"), ("a", "c")]
    assert paths.one_or_more(df.limit(0)).count() == 0


def test_quoted_triples(spark):
    q = T.quoted(e("Alice"), e("knows"), e("Bob"))
    g = graph(spark, [(e("Alice"), e("knows"), e("Bob")), (q, e("confidence"), T.literal(95))])
    assert [r["c"] for r in g.match(q, e("confidence"), "?c").native(c="int").collect()] == [95]
    assert names(g.match(f"<< ?a {e('knows')} ?b >>", e("confidence"), "?c"), "b") == ["Bob"]


def test_updates_and_store(spark, tmp_path):
    df = spark.createDataFrame(papers(), "s string, p string, o string")
    new = spark.createDataFrame([(e("x"), e("y"), e("z")), (e("x"), e("y"), e("z")), papers()[0]], df.schema)
    after, added = insert(df, new)
    assert (after.count(), added.count()) == (len(papers()) + 1, 1)
    left, gone = delete(after, new)
    assert (left.count(), gone.count()) == (len(papers()) - 1, 2)
    assert tuple(verify(after).first()) == (len(papers()) + 1, len(papers()) + 1, 0)
    store = Store(spark, str(tmp_path / "store")).create(df)
    assert store.insert(new) == 1 and store.insert(new) == 0 and store.triples().count() == len(papers()) + 1
    assert store.triples(e("year")).count() == 5
    assert store.delete(new) == 2 and store.triples().count() == len(papers()) - 1


LINES = ['<http://a> <http://p> "x \\"y\\"" .', '<http://a> <http://p> "de"@de-AT .', '<http://a> <http://p> "5"^^<http://www.w3.org/2001/XMLSchema#integer>', "_:b1 <http://p> _:b2 <http://g> .", "# comment", "", "malformed line .", "<http://a> <http://p> <http://o> . # end"]


def test_formats(spark):
    got = {(r["s"], r["o"], r["g"]) for r in formats.parse_lines(spark.createDataFrame([(x,) for x in LINES], "value string")).collect()}
    assert got == {("<http://a>", '"x \\"y\\""', None), ("<http://a>", '"de"@de-AT', None), ("<http://a>", '"5"^^<http://www.w3.org/2001/XMLSchema#integer>', None), ("_:b1", "_:b2", "<http://g>"), ("<http://a>", "<http://o>", None)}
    ttl = '@prefix ex: <http://example.org/> .\n@base <http://base/> .\nex:a a ex:T ; ex:p "x", "y"@en, 5, 2.5, true ; ex:q [] .\n<rel> ex:p """long\n"q" text""" .'
    rows = {(p, o) for s, p, o in formats.turtle(ttl, "d") if s == e("a")}
    xsd = T.XSD
    assert rows == {(T.RDF_TYPE, e("T")), (e("p"), '"x"'), (e("p"), '"y"@en'), (e("p"), f'"5"^^<{xsd}integer>'), (e("p"), f'"2.5"^^<{xsd}decimal>'), (e("p"), f'"true"^^<{xsd}boolean>'), (e("q"), "_:db1")}
    assert ("<http://base/rel>", e("p"), '"long\\n\\"q\\" text"') in set(formats.turtle(ttl, "d"))
    xml = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://example.org/"><ex:T rdf:about="http://example.org/a"><ex:p xml:lang="de">x</ex:p><ex:q rdf:resource="http://example.org/b"/></ex:T></rdf:RDF>'
    assert set(formats.rdfxml(xml, "d")) == {(e("a"), T.RDF_TYPE, e("T")), (e("a"), e("p"), '"x"@de'), (e("a"), e("q"), e("b"))}
    js = '{"@context": {"@vocab": "http://example.org/", "n": "http://example.org/name"}, "@id": "http://example.org/a", "@type": "T", "n": ["x", {"@value": "y", "@language": "en"}], "p": {"@id": "http://example.org/b", "q": 5}}'
    assert set(formats.jsonld(js, "d")) == {(e("a"), T.RDF_TYPE, e("T")), (e("a"), e("name"), '"x"'), (e("a"), e("name"), '"y"@en'), (e("a"), e("p"), e("b")), (e("b"), e("q"), f'"5"^^<{xsd}integer>')}
    df = spark.createDataFrame(papers(), "s string, p string, o string")
    assert formats.parse_lines(formats.to_ntriples(df)).select("s", "p", "o").exceptAll(df).count() == 0
    ex = {"ex": "http://example.org/"}
    text = "\n".join(formats.prefix_lines(ex) + [r["value"] for r in formats.to_turtle(df, ex).collect()])
    assert set(formats.turtle(text, "d")) == set(papers())


def test_term_functions(spark):
    row = spark.createDataFrame([(T.literal("a\n\"b\\"), T.literal("Wien", lang="de-AT"), T.literal(5), e("x"), T.literal(True))], "a string, b string, c string, d string, f string")
    out = row.select(T.lex(F.col("a")), T.lang_matches(F.col("b"), "de"), T.num(F.col("c")), T.lex(F.col("d")), T.boolean(F.col("f")), T.num(F.col("d")), T.equal(F.col("c"), F.lit(f'"5.0"^^<{T.XSD}double>')), T.is_literal(F.col("d")), T.datatype(F.col("a")), T.less(F.col("a"), F.col("b"))).first()
    assert tuple(out) == ('a\n"b\\', True, 5.0, "http://example.org/x", True, None, True, False, f"<{T.XSD}string>", False)


def test_wide_tables(spark):
    rows = []
    for i in range(20):
        n = e(f"n{i}")
        rows += [(n, T.RDF_TYPE, e("Person")), (n, e("name"), T.literal(f"P{i:02}")), (n, e("age"), T.literal(i)), (n, e("city"), T.literal("W")), (n, e("zip"), T.literal("1")), (n, e("knows"), e(f"n{(i + 1) % 20}"))]
        rows += [(n, e("mail"), T.literal(f"m{i}"))] * (i < 15)
    rows += [(e(f"d{i}"), e("text"), T.literal("t")) for i in range(5)]
    df = spark.createDataFrame(rows, "s string, p string, o string")
    found = tables.discover(df)
    assert len(found) == 1 and found[0].nodes == 20 and found[0].coverage[">" + e("mail")] == 0.75 and len(found[0].core) == 8
    wide = tables.materialise(df, found[0])
    assert wide.count() == 20 and tables.scan(wide, present=[">" + e("mail")]).count() == 15
    assert tables.scan(wide, equal={">" + e("name"): T.literal("P03")}, between={">" + e("name"): (None, T.literal("P10"))}).count() == 1
    deep = {r["root"]: r["c0"] for r in tables.deep_table(df, [(e("knows"), e("name"))]).collect()}
    assert deep[e("n19")] == T.literal("P00")


def test_ontology(spark):
    onto = spark.createDataFrame([(e("name"), ontology.DOMAIN, e("Person")), (e("knows"), ontology.RANGE, e("Person")), (e("Student"), ontology.SUBCLASS, e("Person")), (e("Person"), ontology.DISJOINT, e("Rock")), (e("id"), T.RDF_TYPE, ontology.FUNCTIONAL)], "s string, p string, o string")
    data = [(e("a"), T.RDF_TYPE, e("Student")), (e("a"), e("name"), '"A"'), (e("r"), T.RDF_TYPE, e("Rock")), (e("r"), e("name"), '"R"'), (e("untyped"), e("name"), '"U"'), (e("a"), e("knows"), e("r")), (e("b"), T.RDF_TYPE, e("Student")), (e("b"), T.RDF_TYPE, e("Rock")), (e("a"), e("id"), '"1"'), (e("a"), e("id"), '"2"')]
    df = spark.createDataFrame(data, onto.schema)
    assert [r["s"] for r in ontology.domain_violations(df, onto).collect()] == [e("r")]
    assert [r["o"] for r in ontology.range_violations(df, onto).collect()] == [e("r")]
    assert {r["node"] for r in ontology.disjoint_violations(df, onto).collect()} == {e("b")}
    assert [(r["s"], r["n"]) for r in ontology.functional_violations(df, onto).collect()] == [(e("a"), 2)]
    assert ontology.graph_health(df).first()["triples"] == 10


def test_time(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 'p', '1', DATE'2024-01-01', DATE'2024-02-01'), ('a', 'p', '2', DATE'2024-02-01', NULL), ('b', 'p', '3', NULL, NULL) t(s, p, o, since, until)")
    day = lambda x: F.lit(x).cast("date")
    assert sorted(r["o"] for r in temporal.at_time(df, day("2024-01-31")).collect()) == ["1", "3"]
    assert temporal.during(df, day("2024-01-15"), day("2024-02-02")).count() == 3
    assert sorted((r["o"], r["change"]) for r in temporal.difference(df, day("2024-01-31"), day("2024-02-01")).collect()) == [("1", "removed"), ("2", "added")]


def test_stream(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.nt").write_text("\n".join(f"<http://a> <http://p> <http://o{k}> ." for k in range(i + 1)))
    rows = ingest.run_to_end(ingest.stream_ntriples(spark, str(tmp_path)), "test")
    assert sorted(r["o"] for r in rows.collect()) == ["<http://o0>", "<http://o1>", "<http://o2>"]


def test_neighbour_graph(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((90, 5))
    df = spark.createDataFrame([(e(f"v{i:02}"), r.tolist()) for i, r in enumerate(x)], "s string, vec array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -9)
    want = {(e(f"v{i:02}"), e(f"v{j:02}")) for i in range(90) for j in np.argsort(-sim[i])[:4]}
    assert {(r["source"], r["target"]) for r in vector.nearest_neighbours(df, 4, block_rows=20).collect()} == want
    edges = vector.proximity_graph(df, m=2, layers=1)
    assert edges.where("layer = 0").count() == 90 * 4 and edges.where("type = 'vertical'").count() == df.where(vector.top_layer(F.col("s"), 2) >= 1).count()
    assert vector.edge_triples(edges).where(F.col("p") == vector.DESCEND).count() == edges.where("type = 'vertical'").count()


def test_neighbours_of_many_blocks_and_slices(spark):
    """Equal vectors, and ones that single precision can't tell apart; one task's rows are its block's k best, and no pair of blocks is a group."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((60, 6)), 5, axis=0)
    x[::3] += 1e-8 * rng.standard_normal((100, 6))
    x[7] = 0
    names = [e(f"v{i:03}") for i in range(300)]
    df = spark.createDataFrame(list(zip(names, x.tolist(), strict=True)), "s string, vec array<double>").repartition(3)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    want = set()
    for i in range(300):
        sim = (u[i] * u).sum(1)
        sim[i] = -9
        want |= {(names[i], names[j]) for j in np.lexsort((np.arange(300), -sim))[:7]}
    for slice_rows in (1 << 20, 110):
        found = vector.nearest_neighbours(df, 7, block_rows=40, slice_rows=slice_rows)
        assert "CoGroup" not in found._jdf.queryExecution().toString()
        assert {(r["source"], r["target"]) for r in found.collect()} == want
    assert vector.nearest_neighbours(df.limit(1), 7).count() == vector.nearest_neighbours(df.limit(0), 7).count() == 0
    assert vector.nearest_neighbours(df.limit(4), 7).count() == 12


def test_edge_triples_count_pairs_once(spark):
    """A row a pair goes to the shuffle, not one a triple; pairs of both types have three predicates."""
    graph = spark.createDataFrame([("a", "b", "horizontal"), ("a", "b", "horizontal"), ("a", "a", "vertical"), ("a", "c", "horizontal"), ("a", "c", "vertical")], "source string, target string, type string")
    found = vector.edge_triples(graph)
    h, d, n = vector.HORIZONTAL, vector.DESCEND, vector.NEIGHBOUR
    assert sorted(map(tuple, found.collect())) == sorted([("a", n, "b"), ("a", h, "b"), ("a", n, "a"), ("a", d, "a"), ("a", n, "c"), ("a", h, "c"), ("a", d, "c")])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # exploded after the aggregate


def test_large_tables_are_dealt_out_before_they_are_unpivoted(spark, monkeypatch, tmp_path):
    """One row group makes one task's rows; its triples must not."""
    from quillgraph.operators import graph
    from quillgraph.sources.mapping import Table

    path = str(tmp_path / "t.parquet")
    spark.range(900).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name")).coalesce(1).write.parquet(path)
    table = Table(spark.read.parquet(path), "thing", ["k"])
    whole = set(map(tuple, Graph(tables=[table]).triples().collect()))
    monkeypatch.setattr(graph, "TASK_TRIPLES", 300)
    found = Graph(tables=[table]).triples()
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 9 and max(sizes) < 600
    assert len(whole) == 2700 and set(map(tuple, found.collect())) == whole


def test_escapes_by_kinds_are_those_by_pieces(spark):
    r = random.Random(3)
    parts = ["\\", "\\\\", "n", "\\n", "\\u005C", "\\U0000005C", "\\u00E9", "\\U0001F600", "\\uD83D\\uDE00", "\\uD83D", '\\"', "\\z", "a", "é", "\n", "\\u0001", "\u0001", "\\u12", "\\u0034", "\\U00110000"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(2000)] + ["\\u12\\u0033\\u0034\\u1234", "".join(f"\\u{0x4E00 + i:04X}" for i in range(40))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(~T.unescape(F.col("t")).eqNullSafe(F.when(F.contains("t", F.lit("\\")), T._by_pieces(F.col("t"))).otherwise(F.col("t")))).count() == 0


def test_lines_are_matched_once(spark):
    """A condition on a term isn't a second parse below the first."""
    df = spark.createDataFrame([('<http://a> <http://p> "x" .',), ('<http://a> <http://q> "y" .',)], "value string")
    found = formats.parse_lines(df).where(F.col("p") == "<http://p>")
    assert [r["o"] for r in found.collect()] == ['"x"']
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


def test_wide_tables_of_more_sets_than_the_driver_takes(spark):
    rows = []
    for i in range(36):  # each lacks one property of twelve
        rows += [(e(f"n{i:02}"), e(f"p{k:02}"), T.literal(k)) for k in range(12) if k != i % 12]
        rows += [(e(f"m{i:02}"), e(f"q{k}"), T.literal(k)) for k in range(8 if i % 3 else 7)]
    df = spark.createDataFrame(rows, "s string, p string, o string")
    for most in (3, 10_000):
        found = tables.discover(df, most=most)
        assert [x.nodes for x in found] == [36, 36]
        assert {c for x in found for c in x.coverage.values()} == {1.0, 33 / 36, 24 / 36}
        assert [tables.materialise(df, x).count() for x in found] == [36, 36]


def test_escapes_in_one_pass(spark):
    cases = {"a\\\\nb": "a\\nb", "a\\nb": "a\nb", "\\\\\\\\t\\t": "\\\\t\t", "caf\\u00e9": "café", "\\U0001F600!": "😀!", "\\uD83D\\uDE00": "😀", "\\ud83d alone": "\\ud83d alone", "\\q": "\\q", 'say \\"x\\"': 'say "x"', "end\\\\": "end\\"}
    df = spark.createDataFrame([(f'"{x}"', y) for x, y in cases.items()], "t string, want string")
    assert [r["got"] for r in df.select(T.lex(F.col("t")).alias("got")).collect()] == list(cases.values())
    assert [T.parsed(f'"{x}"')[0] for x in cases] == list(cases.values())
    line = spark.createDataFrame([(r'<http://a> <http://p> "café \"q\" \t"@fr .',), (r'<http://é> <http://p> "x" .',), ('<http://a> <http://p> "' + "y\\n" * 20_000 + '" .',)], "value string")
    got = {(r["s"], r["o"]) for r in formats.parse_lines(line).collect()}
    assert got == {("<http://a>", '"café \\"q\\" \t"@fr'), ("<http://é>", '"x"'), ("<http://a>", '"' + "y\\n" * 20_000 + '"')}


def test_counting_different_solutions(spark):
    s = Solutions(spark.createDataFrame([("a", None), ("a", None), ("a", "x"), ("b", "x")], "k string, v string"), ["v"])
    assert s.group(n=count(), d=count(distinct=True)).df.first()[:] == (4, 3)
    assert sorted(tuple(r) for r in s.group("k", d=count(distinct=True), v=count("v", distinct=True)).df.collect()) == [("a", 2, 1), ("b", 1, 1)]


def test_mapped_tables_are_asked_by_their_columns(spark):
    """Conditions and constants are pushed into the scan, joins are on keys, and nothing is a nested loop."""
    from quillgraph import queries

    plan = lambda name: queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,7)" in plan("S2_S5_scan_subject") and "EqualTo(c_custkey,7)" in plan("S2_scan_subject_of_any_predicate")
    assert "Or(And(GreaterThan(c_acct" in plan("P5_P8_filters") and "GreaterThan(o_total" in plan("J8_not_exists")  # cut short there
    for name in ("J1_bgp_chain", "J6_optional", "J6_optional_filter", "J7_exists", "J8_not_exists"):
        text = plan(name)
        assert "NestedLoop" not in text and "Cartesian" not in text
        assert "<http://ex.org/" not in text or "Join" in text
    joined = [x for x in plan("J1_bgp_chain").split("\n") if "Join" in x]
    assert joined and not any("concat" in x for x in joined)
    other = [x for x in plan("O1_O4_top_k").split("\n") if "TakeOrdered" in x]
    assert other and "o_totalprice" in plan("O1_O4_top_k")


def test_patterns_that_share_nothing_must_ask_for_products(g):
    a, b = g.match("?x", e("author"), "?y"), g.match("?v", e("cites"), "?w")
    for join in (a.join, a.optional, a.exists, a.not_exists):
        with pytest.raises(ValueError):
            join(b)
    assert a.exists(b, product=True).df.count() == 2 and a.not_exists(b, product=True).df.count() == 0 and a.optional(b, product=True).df.count() == 6


def test_store_versions(spark, tmp_path):
    df = spark.createDataFrame(papers(), "s string, p string, o string")
    store = Store(spark, str(tmp_path / "store"))
    assert store.triples().count() == 0 and store.clear() == 0
    store.create(df)
    years = df.where(F.col("p") == e("year"))
    before = store._newest()[1]
    assert store.delete(years) == 5 and store.delete(years) == 0
    after = store._newest()[1]
    changed = [b for b in before if after.get(b) != before[b]]
    assert len(changed) == 1 and store.triples().exceptAll(df.subtract(years)).count() == 0
    (tmp_path / "store" / "triples-unfinished").mkdir()  # of a write that failed: not named, so not read
    assert Store(spark, str(tmp_path / "store")).triples().count() == len(papers()) - 5
    assert store.copy_to(str(tmp_path / "copy")).triples().count() == len(papers()) - 5
    assert store.replace(years).triples().count() == 5 and store.clear() == 5 and store.triples().count() == 0


def test_registry(spark):
    from quillgraph.operators.registry import Registry

    r, p = Registry(spark), e("emb")
    r.declare(p, 2, "DotProduct")
    for bad in (lambda: r.declare(p, 2), lambda: r.declare(e("x"), 2, "taxicab"), lambda: r.declare(e("x"), 0), lambda: r.search(p, [1.0])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        r.live(e("nobody"))
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [1.0]), ("d", None), (None, [1.0, 1.0]), ("e", [float("nan"), 1.0])], "s string, vec array<double>")
    assert sorted(str(x["s"]) for x in r.insert(p, rows).collect()) == ["None", "c", "d", "e"]
    assert [x["s"] for x in r.search(p, [0.0, 1.0], k=1).df.collect()] == ["b"]
    assert r.delete(p, spark.createDataFrame([("b",), ("z",)], "s string")) == 1
    assert [x["s"] for x in r.search(p, [0.0, 1.0]).df.collect()] == ["a"]
    assert r.compact(p) == 1 and r.compact(p) == 0 and r.vectors[p].count() == 1


def test_path_groups_and_segments(spark):
    rows = []
    for i in range(60):
        rows += [(e(f"r{i}"), e("a"), e(f"m{i}")), (e(f"m{i}"), e("x"), '"1"'), (e(f"m{i}"), e("y"), '"2"')] + [(e(f"m{i}"), e("z"), '"3"')] * (i < 10)
        rows += [(e(f"q{i}"), e("b"), e(f"hub{i % 2}"))]
    rows += [(e(f"hub{k}"), e(p), '"h"') for k in range(2) for p in ("u", "v")]
    df = spark.createDataFrame(rows, "s string, p string, o string")
    got = {(len(r["paths"]), r["roots"], r["kept"]) for r in tables.discover_paths(df).collect()}
    assert got == {(2, 50, True), (2, 60, False)}
    wide = spark.createDataFrame([(i, f"{i * 7 % 100:02}", None if i % 4 else "x") for i in range(100)], "node int, v string, w string").repartition(7)
    stats = [r.asDict() for r in tables.column_statistics(wide, 32).where("column = 'v'").orderBy("segment").collect()]
    assert [(r["rows"], r["segment"]) for r in stats] == [(32, 0), (32, 1), (32, 2), (4, 3)]


def test_paths_are_found_in_triples_that_repeat(spark):
    e = lambda x: f"<http://x/{x}>"
    rows = [(e(f"a{i}"), e("to"), e(f"b{i // 3}")) for i in range(60)] + [(e(f"b{i}"), e(p), '"v"') for i in range(20) for p in ("u", "v")]
    df = spark.createDataFrame(rows + [(e("a0"), e("name"), '"b0"')], "s string, p string, o string")
    once = sorted(map(tuple, tables.two_step_paths(df).collect()))
    assert once == [(e("to"), e(p), 60, 20, 3.0) for p in ("u", "v")]
    assert sorted(map(tuple, tables.two_step_paths(df.unionByName(df)).collect())) == once
    assert [(r["roots"], r["fan_in"], r["kept"]) for r in tables.discover_paths(df.unionByName(df)).collect()] == [(60, 3.0, True)]
