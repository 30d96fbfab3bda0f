"""Operators of the lookup and linking side on small inputs with known results."""

import json

import pytest
from pyspark.sql import functions as F

from entweave import lexicon as L
from entweave.functions import text as X
from entweave.operators import docs, graph, lookup, rerank, store, tables, typing
from entweave.sources import dump, text_sources


def one(spark, column, **values):
    types = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], types).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "function, text, expect",
    [
        (X.normalize, " a \t b\x1c ", "a b"),
        (X.exact_name, "  Köln-Straße ", "koln strasse"),
        (X.exact_name, "A.B  (c)", "a b c"),
        (X.exact_name, "", ""),
        (X.mention_surface, "Caspian Sea*[n 1].", "Caspian Sea"),
        (X.label_normalize, "Foo--Bär 7", "foo bär 7"),
        (X.lab_normalize, "Straße Ä7", "strasse 7"),
        (X.strip_html, "<p>a&amp;b</p> <i>c</i>", "a&b c"),
    ],
)
def test_text_functions(spark, function, text, expect):
    assert one(spark, function(F.col("t")), t=text) == expect


def test_tokens_and_similarity(spark):
    assert one(spark, X.tokenize(F.col("t")), t="Größe_und 2 Maße!") == ["grösse", "und", "2", "masse"]
    assert one(spark, X.char_ngrams(F.col("t")), t="ab cd") == ["abc", "bcd"]
    assert one(spark, X.name_similarity(F.col("a"), F.col("b")), a="lake", b="lake") == 1.0
    assert one(spark, X.name_similarity(F.col("a"), F.col("b")), a="", b="lake") == 0.0
    assert one(spark, X.name_similarity(F.col("a"), F.col("b")), a="rome", b="roma") == pytest.approx(0.75)


@pytest.mark.parametrize("cap, expect", [(100, "abc; de; f"), (7, "abc; de"), (6, "abc"), (2, "ab"), (0, "")])
def test_bounded_join_stops_at_the_first_that_does_not_fit(spark, cap, expect):
    assert one(spark, X.bounded_join(F.col("t"), cap), t=["abc", "de", "", "abc", "f"]) == expect


def test_typing(spark):
    kinds = lambda text: one(spark, typing.lexical_types(F.col("t")), t=text)
    assert kinds("sovereign state in Europe").fine == ["COUNTRY"]
    assert kinds("a lake and its island")["coarse"] == ["LOCATION"]
    assert kinds("nothing to see")["fine"] == ["MISC"]
    tie = kinds("a film and a company")
    assert tie.fine == ["COMPANY", "FILM"] and tie.coarse == ["ORGANIZATION", "WORK"]
    assert kinds("one battle")["fine"] == ["MISC"] and kinds("a battle in the war").fine == ["CONFLICT"]


def prune(spark, edges, profile="PERSON", **limits):
    e = spark.createDataFrame(edges, "subject_qid string, predicate_pid string, object_qid string, rank string")
    who = spark.createDataFrame([("Q1", [profile])], "qid string, profiles array<string>")
    rows = graph.prune(graph.best_edges(graph.score_edges(e, who)), **limits).orderBy("pos").collect()
    return [(r.predicate_pid, r.object_qid) for r in rows]


def test_pruning_goes_round_the_predicates(spark):
    edges = [("Q1", p, o, "normal") for p, o in (("P106", "Q10"), ("P106", "Q11"), ("P106", "Q12"), ("P27", "Q20"), ("P27", "Q21"), ("P999", "Q30"), ("P106", "Q1"), ("X1", "Q9"))]
    assert prune(spark, edges) == [("P106", "Q10"), ("P27", "Q20"), ("P999", "Q30"), ("P106", "Q11"), ("P27", "Q21")]
    assert prune(spark, edges, total=2) == [("P106", "Q10"), ("P27", "Q20")]
    assert len(prune(spark, edges, total=0, per_predicate=0)) == 6
    ranks = [("Q1", "P106", "Q10", "deprecated"), ("Q1", "P106", "Q11", "preferred"), ("Q1", "P106", "Q10", "normal"), ("Q1", "P31", "Q5", "normal"), ("Q1", "P31", "P7", "normal")]
    assert prune(spark, ranks) == [("P106", "Q11"), ("P31", "Q5"), ("P106", "Q10"), ("P31", "P7")]


def test_scores_by_profile(spark):
    assert L.PROFILE_BONUS["PERSON", "P106"] == 18 and L.PROFILE_BONUS["LOCATION", "P31"] == -2 and len(L.PREDICATE_SCORES) == 41 and len(L.TYPING_RULES) == 29 and len(L.STOPWORDS) == 49


def test_even_sample(spark):
    got = [r.id for r in graph.even_sample(spark.range(10), ["id"], 4).orderBy("id").collect()]
    assert got == [0, 2, 5, 7]
    assert graph.even_sample(spark.range(3), ["id"], 4).count() == 3


ENTITIES = "qid string, label string, labels array<string>, aliases array<string>, coarse_type string, fine_type string, prior double, popularity double, wikipedia_url string, dbpedia_url string"


def test_lookup_context_beats_name(spark):
    e = spark.createDataFrame(
        [("Q1", "Pear Works", ["Pear Works"], ["Pear"], "ORGANIZATION", "COMPANY", 0.9, 9.0, "u1", ""), ("Q2", "Pear", ["Pear"], [], "PRODUCT", "FOOD_BEVERAGE", 0.2, 1.0, "u2", ""), ("Q3", "Oak", ["Oak"], [], "MISC", "MISC", 0.1, 0.0, "", ""), ("Q4", "phones maker", [], [], "MISC", "MISC", 0.0, 0.0, "", "")], ENTITIES
    )
    t = spark.createDataFrame([("Q1", "P452", "Q4")], "subject_qid string, predicate_pid string, object_qid string")
    m = spark.createDataFrame([("a", "pear", ["phones", "maker"], ["ORGANIZATION", "PRODUCT"], []), ("b", "zzz", [], [], []), ("c", "oa_", [], [], []), ("d", "q", [], [], [])], "mention_id string, mention string, context array<string>, coarse_hints array<string>, fine_hints array<string>")
    r = lookup.lookup(e, t, m).orderBy("mention_id", "final_rank").collect()
    assert [(x.mention_id, x.qid) for x in r] == [("a", "Q2"), ("a", "Q1"), ("c", "Q3")]
    a = {x.qid: x for x in r if x.mention_id == "a"}
    assert a["Q1"].context_score == 1.0 and a["Q1"].exact_name_match and a["Q2"].name_score == 1.0 and a["Q2"].type_score == 0.5
    linked = lookup.fuzzy_candidates(lookup.prepare(m.withColumn("crosslinks", F.array(F.lit("u1")))), e).where("mention_id = 'd'").collect()
    assert [(x.qid, x.score) for x in linked] == [("Q1", 1.5)]


def test_type_hints_are_checked(spark):
    m = spark.createDataFrame([("a", "x", ["bad hint!"])], "mention_id string, mention string, coarse_hints array<string>")
    with pytest.raises(Exception, match="type hint"):
        lookup.prepare(m).collect()


def line(**e):
    return (json.dumps(e) + ",",)


def test_dump_to_records(spark):
    snak = lambda v, rank="normal", kind="value": {"rank": rank, "mainsnak": {"snaktype": kind, "datavalue": {"value": v}}}
    text = lambda **t: {k: {"language": k, "value": v} for k, v in t.items()}
    rows = [
        ("[",), ("",), ("]",),
        line(id="Q1", type="item", labels=text(en=" Rome ", it="Roma", mul="Rome"), aliases={"en": [{"value": "Roma"}, {"value": "Urbs"}, {"value": "Urbs"}]}, descriptions=text(en="capital of Italy"),
             claims={"P31": [snak({"entity-type": "item", "numeric-id": 515}), snak({"id": "Q515"}), snak("text"), snak({"id": "Q7"}, kind="novalue")], "P17": [snak({"id": "Q38"}, "preferred")]}, sitelinks={"itwiki": {"title": "Roma (città)"}, "commonswiki": {"title": "x"}}),
        line(id="P31", type="property", labels=text(en="instance of")), line(id="L9", labels=text(en="no")), line(id="Q3", labels={}), line(id="Q4", labels=text(de="Karl"), claims={"P31": [snak({"id": "Q5"})], "P106": [snak({"id": "Q82955"})]}),
    ]
    raw = dump.parse(spark.createDataFrame(rows, "value string"))
    got = {r.qid: r for r in dump.records(raw).collect()}
    assert set(got) == {"Q1", "P31", "Q4"}
    rome = got["Q1"]
    assert (rome.label, rome.labels, rome.aliases, rome.types, rome.fine_type, rome.popularity) == ("Rome", ["Rome", "Roma"], ["Urbs"], ["Q515"], "CITY", 2.0)
    assert rome.wikipedia_url == "https://it.wikipedia.org/wiki/Roma_(citt%C3%A0)" and rome.dbpedia_url == "http://it.dbpedia.org/resource/Roma_%28citt%C3%A0%29"
    assert (got["P31"].item_category, got["P31"].fine_type) == ("PREDICATE", "PROPERTY") and got["Q4"].types == ["Q5", "Q82955"] and got["Q4"].fine_type == "HUMAN"
    assert {tuple(r) for r in dump.edges(raw).where("subject_qid = 'Q1'").collect()} == {("Q1", "P31", "Q515", "normal"), ("Q1", "P17", "Q38", "preferred")}
    with pytest.raises(Exception, match="no JSON"):
        dump.parse(spark.createDataFrame([("{broken",)], "value string")).collect()


@pytest.mark.parametrize("url, ref", [("https://en.wikipedia.org/wiki/Rome", "Rome"), ("https://it.wikipedia.org/wiki/Roma", "it.wikipedia.org|Roma"), ("odd", "odd")])
def test_refs(spark, url, ref):
    assert one(spark, dump.compact_ref(F.col("u")), u=url) == ref
    if url != "odd":
        assert one(spark, dump.expand_ref(F.col("r"), "wikipedia"), r=ref) == url


def test_csv_and_requested_order(spark, tmp_path):
    (tmp_path / "t1.csv").write_text('col0,"b,c"\n1,"x ""y""\nz"\n2\n')
    cells = {(r.row_id, r.col_id): r.value for r in text_sources.csv_cells(spark, str(tmp_path / "t1.csv")).collect()}
    assert cells == {(0, 0): "col0", (0, 1): "b,c", (1, 0): "1", (1, 1): 'x "y"\nz', (2, 0): "2"}
    ids = spark.createDataFrame([(0, "Q2"), (1, "Q9"), (2, "Q2")], "pos long, qid string")
    found = spark.createDataFrame([("Q2", "b")], "qid string, label string")
    assert [(r.qid, r.found) for r in text_sources.in_requested_order(ids, found, "qid").orderBy("pos").collect()] == [("Q2", True), ("Q9", False)]
    with pytest.raises(Exception, match="missing"):
        text_sources.in_requested_order(ids, found, "qid", allow_missing=False).collect()


def test_store(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 5)], "k string, v int, t int")
    new = spark.createDataFrame([("b", 2, 3), ("c", 3, 1)], "k string, v int, t int")
    assert sorted(map(tuple, store.upsert(old, new, ["k"], "t").collect())) == [("a", 1, 1), ("b", 2, 3), ("c", 3, 1)]
    t = spark.createDataFrame([("s1", "p", "o"), ("s2", "p", "o")], "subject_qid string, predicate_pid string, object_qid string")
    assert [r.subject_qid for r in store.replace_triples(t, t.where("subject_qid = 's1'"), t.limit(0)).collect()] == ["s2"]
    assert one(spark, store.replicated_id(F.col("q"), F.lit(1), 100), q="Q7") == "Q207" and one(spark, store.replicated_id(F.col("q"), F.lit(1), 100), q="x") == "x__r2"


def test_documents_fit_their_bytes(spark):
    doc = json.dumps({"id": "Q1", "context": "word " * 300, "bow": "b " * 50, "aliases": {"en": ["x" * 50] * 4}})
    cut = one(spark, docs.trim_to_bytes(F.col("d"), 300), d=doc)
    assert len(cut.encode()) <= 300 and json.loads(cut)["id"] == "Q1"
    assert one(spark, docs.trim_to_bytes(F.col("d"), 4096), d='{"id":"Q2"}') == '{"id":"Q2"}'


LAKES = [["col0", "col1", "col2", "col3"], ["Lake One", "Canada", "371 km2", "some long text " * 6], ["Sea Two", "Iran", "82 km2", "another rather long text " * 4], ["Lake Three", "Uganda", "68 km2", "text of many words here " * 4]]


def melt(spark, name, rows):
    return spark.createDataFrame([(name, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)], "table_id string, row_id long, col_id int, value string")


def test_geography_table(spark):
    cells = melt(spark, "t", [row[:3] + [row[2].replace("km2", "m"), row[3]] for row in LAKES])
    got = {r.col_id: r for r in tables.roles(tables.column_stats(cells)).collect()}
    assert got[0].family == "GEOGRAPHY" and got[0].role == "BODY_OF_WATER_NAME" and got[1].role == "COUNTRY" and got[2].role == "AREA_MEASURE" and got[4].role == "DESCRIPTION_TEXT"


def test_linking_prefers_the_water(spark):
    cells = melt(spark, "t", [row[:3] + [row[2], row[3]] for row in LAKES])
    target = spark.createDataFrame([("t", 1, 0)], "table_id string, row_id long, col_id int")
    schema = tables.seed_schema(tables.cell_contexts(cells, target), tables.roles(tables.column_stats(cells)))
    s = schema.first()
    assert s.fine_hints == ["LANDMARK"] and s.strength == "medium" and s.other_row_values[0] == "Canada" and s.column_samples == ["Sea Two", "Lake Three"]
    candidates = spark.createDataFrame(
        [("Q1", "Lake One", [], "LOCATION", "LANDMARK", "ENTITY", 0.6, "u", "freshwater; canada", "lake in canada", 50.0), ("Q2", "Lake One", [], "WORK", "FILM", "ENTITY", 0.7, "u", "film", "a film", 60.0), ("Q3", "Lake One (station)", [], "MISC", "MISC", "ENTITY", 0.1, None, "", "railway station", 40.0)],
        "qid string, label string, aliases array<string>, coarse_type string, fine_type string, item_category string, prior double, wikipedia_url string, context_string string, description string, es_score double",
    )
    ranked = rerank.rerank(rerank.features(rerank.cell_tokens(schema).crossJoin(candidates)))
    rows = ranked.orderBy("reranked_rank").collect()
    assert rows[0].qid == "Q1" and {r.qid: r.candidate_family for r in rows}["Q2"] in ("CREATIVE_WORK", "PRIMARY")
    d = rerank.decide(ranked).first()
    assert d.selected_qid == "Q1" and not d.abstain and "strong_lexical_match" in d.reason_codes and 0 < d.confidence <= 1
    gold = target.withColumn("gold_qid", F.lit("Q1"))
    e = rerank.summary(rerank.decide(ranked), gold, rerank.diagnostics(ranked, gold), ["table_id"]).first()
    assert (e.accuracy, e.coverage, e.recall_at_1, e.mean_rank) == (1.0, 1.0, 1.0, 1.0)


def test_streamed_upsert_is_the_batch_upsert(spark, tmp_path):
    from entweave.streaming import incremental

    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "k string, v int, t int"
    for rows in ([("a", 1, 1), ("b", 1, 1)], [("a", 2, 2), ("c", 9, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.keep_upserted(incremental.changed_files(spark, src, schema), out, ["k"], "t", cp).awaitTermination()
    assert sorted(map(tuple, incremental.snapshot(spark, out).collect())) == [("a", 2, 2), ("b", 1, 1), ("c", 9, 1)]
    for v in range(3, 6):  # versions that nothing needs any more go
        spark.createDataFrame([("a", v, v)], schema).coalesce(1).write.mode("append").parquet(src)
        incremental.keep_upserted(incremental.changed_files(spark, src, schema), out, ["k"], "t", cp).awaitTermination()
    assert sorted(map(tuple, incremental.snapshot(spark, out).collect())) == [("a", 5, 5), ("b", 1, 1), ("c", 9, 1)]
    from pathlib import Path

    assert len(list(Path(out, "manifest").glob("v=*"))) == 2 and len(list(Path(out, "data").glob("v=*"))) <= 4


def test_registered_queries_have_names_and_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 70


def test_arguments():
    import pytest

    from entweave import arguments as a

    assert a.languages("EN, it,,en") == ["en", "it"] and a.item_ids("q5, Q42\nq5") == ["Q5", "Q42"] and a.entity_ids("P31,Q1") == ["P31", "Q1"]
    for bad in (lambda: a.languages(" ,"), lambda: a.languages("e_n"), lambda: a.item_ids("P31"), lambda: a.entity_ids("q1"), lambda: a.item_ids("Q01"), lambda: a.one_selector(ids=None, count=None), lambda: a.one_selector(ids=["Q1"], count=3), lambda: a.identifier("a; drop"), lambda: a.first_existing([])):
        with pytest.raises((ValueError, FileNotFoundError)):
            bad()
    assert a.one_selector(ids=None, count=0) == "count" and a.identifier("x.y_1") == "x.y_1"
    assert a.merged({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 3}, "d": {"e": 1}}) == {"a": {"b": 3, "c": 2}, "d": {"e": 1}}


def test_dump_lines_have_numbers(spark, tmp_path):
    import gzip

    import pytest

    from entweave.sources import subset

    good = [json.dumps({"id": f"Q{i}", "labels": {"en": {"value": f"l{i}"}}}) + "," for i in range(1, 40)]
    for name, opened in (("a.json", open), ("b.json.gz", gzip.open)):
        with opened(tmp_path / name, "wt") as f:
            f.write("[\n" + "\n".join(good) + "\n\n12,\n]\n")
    lines = subset.numbered_lines(spark, str(tmp_path / "*.json*")).collect()
    assert {(x.file.rsplit("/", 1)[1], x.line_no) for x in lines} == {(n, i) for n in ("a.json", "b.json.gz") for i in range(1, 44)}
    assert all(x.value == good[x.line_no - 2] for x in lines if 2 <= x.line_no <= 40)
    one_file = subset.numbered_lines(spark, str(tmp_path / "a.json"))
    assert [x.id for x in dump.parse(one_file, limit=3).orderBy("line_no").collect()] == ["Q1", "Q2", "Q3"]
    assert subset.estimated_records(spark, str(tmp_path / "a.json")) == 40 and subset.estimated_records(spark, str(tmp_path / "b.json.gz"), limit=7) == 7
    (tmp_path / "bad.txt").write_text("[\n{\"id\": \"Q1\"},\n{broken\n")
    with pytest.raises(Exception, match="no JSON: line 3 of .*bad.txt"):
        dump.parse(subset.numbered_lines(spark, str(tmp_path / "bad.txt"))).count()


def test_benchmark_folders_and_arrays(spark, tmp_path):
    import pytest

    from entweave import sinks
    from entweave.sources import subset

    for d, sub, name in (("b", "target", "cta_target.csv"), ("a", "targets", "CTA_2T_WD_targets.csv")):
        (tmp_path / "root" / d / sub).mkdir(parents=True)
        (tmp_path / "root" / d / sub / name).write_text("")
    assert subset.dataset_ids(str(tmp_path / "root")) == ["a", "b"] and subset.dataset_files(str(tmp_path / "root"), "a")["cta_targets"].endswith("CTA_2T_WD_targets.csv")
    with pytest.raises(FileNotFoundError):
        subset.dataset_files(str(tmp_path / "root"), "c")
    docs = spark.range(57).selectExpr("id", "to_json(struct(id)) as j").repartition(4)
    sinks.write_dump_array(docs, "j", ["id"], str(tmp_path / "array"))
    whole = "".join(p.read_text() for p in sorted((tmp_path / "array").glob("part-*")))
    assert json.loads(whole) == [{"id": i} for i in range(57)]


def test_cells_without_candidates_are_left_open(spark):
    cells = spark.createDataFrame([("t", 1, 0), ("t", 2, 0)], "table_id string, row_id long, col_id int")
    from entweave.operators import resolution, triggers
    from entweave.plans import decision_queries as q

    ranked = rerank.rerank(q.candidates(spark, "/root/testdata/sf0.001").where("k = 1").drop("t", "k").withColumns({"table_id": F.lit("t"), "row_id": F.lit(1).cast("long"), "col_id": F.lit(0)}))
    d = rerank.decide(ranked, targets=cells)
    rows = {x.row_id: x for x in d.collect()}
    assert rows[2].abstain and rows[2].reason_codes == ["no_candidates"] and rows[2].confidence == 0 and rows[1].selected_qid
    nothing = spark.createDataFrame([], "table_id string, row_id long, col_id int, should_run boolean, reason_codes array<string>")
    kept = resolution.resolve(d, ranked, nothing, nothing).collect()
    assert {x.resolution_mode for x in kept} == {"deterministic_only"} and len(kept) == 2
    none = triggers._without_candidates(d, rerank.CELL).first()
    assert none.row_id == 2 and not none.should_run and none.reason_codes == ["no_candidates"]


def test_written_tables_of_many_rows_are_not_broadcast(spark):
    """A compressed file tells little of its rows: 30,000 equal rows of a few KB on disk were collected in the driver."""
    from entweave.scratch import written

    rows = lambda n: spark.range(n).select((F.col("id") % 7).alias("k"), F.lit("x" * 50).alias("v"))
    many, few = written(rows(30_000), "many"), written(rows(10), "few")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(many.join(many.select("k", F.upper("v").alias("w")), "k"))
    assert "Broadcast" in plan(many.select("k").distinct().select(F.lit(1).alias("k")).union(few.select("k")).join(few, "k"))


def test_numbered_names_meet_few_of_their_like(spark):
    """Trigrams of numbered names are common; longer substrings find the same pairs, and far fewer are compared."""
    names = spark.range(3000).select(F.format_string("customer#%09d", "id").alias("name")).unionByName(spark.createDataFrame([("lake",), ("blue lake",)], "name string"))
    asked = spark.createDataFrame([("Customer#000000123",), ("0000001%23",), ("00002999",), ("LAKE",), ("ke",), ("0012",)], "mention string")
    pairs = lookup.matching_names(asked, names)
    found = {}
    for r in pairs.collect():
        found.setdefault(r["mention"], set()).add(r["name"])
    number = lambda i: f"customer#{i:09d}"
    import re

    every = [number(i) for i in range(3000)]
    assert found == {"Customer#000000123": {number(123)}, "0000001%23": {x for x in every if re.search("0000001.*23", x)}, "00002999": {number(2999)}, "LAKE": {"lake", "blue lake"}, "ke": {"lake", "blue lake"}, "0012": {x for x in every if "0012" in x}}
    longest = lookup.matching_names(spark.createDataFrame([(number(i),) for i in range(0, 3000, 3)], "mention string"), names)
    assert longest.count() == 1000 and "substring(name" in longest._jdf.queryExecution().optimizedPlan().toString() and ", 12)" in longest._jdf.queryExecution().optimizedPlan().toString()


def test_requests_in_stages_without_hits_of_later_ones(spark):
    asked = spark.createDataFrame([("t", 1, 0, 1, "a"), ("t", 1, 0, 2, "b"), ("t", 1, 0, 3, "a2"), ("t", 2, 0, 1, "z"), ("t", 2, 0, 2, "a")], "table_id string, row_id long, col_id int, stage_no int, mention_id string")
    best = spark.createDataFrame([("a", "Q1", 1.0), ("b", "Q1", 3.0), ("b", "Q2", 2.0), ("a2", "Q9", 9.0)], "mention_id string, qid string, es_score double")
    plain = rerank.staged(asked.join(best, "mention_id").drop("mention_id"), enough=2)
    got = rerank.staged_requests(asked, best, enough=2)
    rows = lambda df: sorted((r["row_id"], r["qid"], r["es_score"], tuple(r["stages"])) for r in df.collect())
    assert rows(got) == rows(plain) == [(1, "Q1", 3.0, (1, 2)), (1, "Q2", 2.0, (2,)), (2, "Q1", 1.0, (2,))]


def test_linking_takes_every_table(spark):
    from entweave.plans import table_queries as Q

    cells = Q.cells_of(spark, "/root/testdata/sf0.001")
    n = {r["table_id"]: r["count"] for r in cells.groupBy("table_id").count().collect()}
    source = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").count()
    assert n == {"customer": source("customer"), "supplier": source("supplier"), "part": source("part"), "nation": source("nation"), "people": source("supplier"), "lakes": source("nation")}


def test_estimate_without_a_sample_is_a_count(spark, tmp_path):
    from entweave.sources import subset

    # the first records are the short ones: their mean size says nothing of the rest
    text = spark.range(60, numPartitions=1).select(F.when(F.col("id") < 10, "{}").otherwise(F.lit("x" * 90)).alias("value"))
    text.write.text(str(tmp_path / "dump"))
    count = lambda **k: subset.estimated_records(spark, str(tmp_path / "dump"), **k)
    assert count(sample=10) > 1000 and count(sample=None) == count() == 60


def test_parts_of_any_number_keep_their_italian_alias(spark, monkeypatch):
    from entweave.plans import ingest_queries as Q

    line = '{"id":"%s","labels":{"en":{"value":"a"},"it":{"value":"a (it)"}},"descriptions":{"en":{"value":"%s"}},"aliases":{"en":[{"value":"b"},{"value":"b"}],"it":[{"value":"a"}]}}'
    lines = spark.createDataFrame([(line % x,) for x in (("Q5000001", "product"), ("Q6000000", "product"), ("Q3000000", "company"))], "value string")
    monkeypatch.setattr(Q, "raw", lambda s, d, *fields: dump.parse(lines))
    assert {(r["qid"], r["n_en"], r["has_it"]) for r in Q.t3_alias_map(spark, "").collect()} == {("Q5000001", 1, True), ("Q6000000", 1, True), ("Q3000000", 1, False)}


def test_lists_of_outside_schemas_are_parsed_once(spark):
    from entweave.operators import schemas

    j = F.lit('{"a":[{"value":"x"},"x","y"]}')
    assert [s.value for s in one(spark, schemas.signals(j, "$.a"))] == ["x", "y"]
    plan = spark.range(1).select(schemas.signals(F.col("id").cast("string"), "$.a").alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("get_json_object") == 1  # 8 before


def test_dump_lines_are_parsed_once(spark):
    """One JSON parse a line, of the wanted fields; broken lines still end the job, odd ones are told from them."""
    rows = ['{"id":"Q1","labels":{"en":{"value":"a"}},"claims":{"P1":[{"rank":"normal"}]}},', '{"id":"Q2","labels":[]}', '[1]', '5,', '"x"', "[", "]", " ", '{"id":7}', '{"id":"L1"}', '{"id":"P9","labels":{"en":{"value":5}}},\r']
    raw = dump.parse(spark.createDataFrame([(r,) for r in rows], "value string"), fields=["labels"])
    assert raw.columns == ["id", "labels"]
    got = {r["id"]: r["labels"] for r in raw.collect()}
    assert set(got) == {"Q1", "Q2", "P9"} and got["Q1"]["en"]["value"] == "a" and not got["Q2"]
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "claims" not in plan  # 2 and all fields before
    for bad in ("{broken", '{"id":"Q1"', "broken", '{"id":"Q1","claims":{"P1":[}}'):
        with pytest.raises(Exception, match="no JSON"):
            dump.parse(spark.createDataFrame([(bad,)], "value string"), fields=["labels"]).count()
        assert dump.parse(spark.createDataFrame([(bad,)], "value string"), strict=False).where("id <> 'Q1'").count() == 0


def test_graph_is_cut_by_its_rows(spark, monkeypatch):
    """A task sorts so many edges at most, whatever the session's number of partitions; rows move once."""
    from entweave.plans import fixtures as fx
    from entweave.plans import ingest_queries as Q

    sf, n = "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    monkeypatch.setattr(fx, "EDGES_A_TASK", n // 20)
    assert fx.edge_tasks(spark, sf) >= 40
    plan = Q.g5_predicate_order(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "REPARTITION_BY_COL" not in plan
    cut = sorted(map(tuple, Q.sc11_j2_context_strings(spark, sf).collect()))
    e = fx.entities(spark, sf)
    assert cut == sorted(map(tuple, graph.context_strings(fx.triples(spark, sf), e.select("qid", "label")).collect()))


def test_candidates_of_the_rules_move_once_as_numbers(spark):
    from entweave.operators import triggers
    from entweave.plans import decision_queries as Q

    c = Q.candidates(spark, "/root/testdata/sf0.001")
    assert c._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert Q.ranked(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # 2 before
    plain = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(*[F.expr(Q._column(x)).alias(x) for x in Q.CANDIDATE]).distinct()
    assert c.exceptAll(plain).isEmpty() and plain.exceptAll(c).isEmpty()
    r = Q.with_tokens(Q.ranked(spark, "/root/testdata/sf0.001"))
    assert "qid" not in triggers._tops(r, Q.KEYS, 5, triggers._OF_SEMANTIC).schema["c"].dataType.elementType.names
