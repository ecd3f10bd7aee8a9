"""Names, prompts, charsets, registries, files and other operators on hand-made rows."""

import hashlib
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from annotara.functions import labels
from annotara.functions import tokens as T
from annotara.operators import assistants, encoders, extraction, output, registry, retrieval, spans, stats
from annotara.plans import drivers, more
from annotara.sources import readers, sinks, staging
from annotara.streaming import rates


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


# -- models by name


def test_encoders_are_known_by_name_and_load_late():
    for name in ("bge-s", "bge-l", "legal-bert", "qwen3-0.6b", "qwen3-8b", "splade"):
        model = encoders.encoder(name, path="/nowhere")
        assert model.name == name and model.similarity == ("dot" if name == "splade" else "cosine")
        with pytest.raises(RuntimeError, match="isn't installed"):
            model.documents(["x"])
    assert set(encoders.ENCODERS) <= set(encoders.RETRIEVERS)
    with pytest.raises(ValueError, match="no retriever"):
        encoders.retriever("unknown")


def test_vectors_retrieve_by_name(spark):
    pool = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox runs", "blue whale swims", "green frog"])], "row_idx long, text string")
    q = spark.createDataFrame([(7, "a blue whale"), (8, "frog")], "qid long, qtext string")
    got = {(r.qid, r["rank"]): r.row_idx for r in encoders.retriever("hashing")(pool, q, 1, "qid").collect()}
    assert got == {(7, 1): 1, (8, 1): 2}


def test_pooling():
    states, mask = np.array([[[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]]]), np.array([[1.0, 1.0, 0.0]])
    assert encoders.mean_pooled(states, mask).tolist() == [[2.0, 3.0]]


def test_assistants_are_known_by_name(monkeypatch):
    with pytest.raises(ValueError, match="no assistant"):
        assistants.assistant("unknown")
    with pytest.raises(RuntimeError, match="isn't installed"):
        assistants.assistant("phi-4").generate([{"role": "user", "content": "x"}])
    asked = []

    def answer(request, timeout):
        asked.append((request.full_url, json.loads(request.data), request.headers.get("Authorization")))
        if len(asked) == 1:
            raise assistants.urllib.error.URLError("busy")
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": "ok"}}]}).encode())

    monkeypatch.setattr(assistants.urllib.request, "urlopen", answer)
    assert assistants.assistant("endpoint", model="m", base="http://h/v1/", key="k").generate([{"role": "user", "content": "x"}], max_tokens=5) == "ok"
    assert asked[1] == ("http://h/v1/chat/completions", {"model": "m", "messages": [{"role": "user", "content": "x"}], "temperature": 1.0, "max_tokens": 5}, "Bearer k")


def test_batches_reach_models_at_once(spark):
    class Many:
        def generate(self, messages, **options):
            raise AssertionError

        def generate_all(self, asked):
            return [f"{len(asked)}:{m[-1]['content']}" for m in asked]

    rows = spark.createDataFrame([(i, f"t{i}") for i in range(3)], "i int, text string").coalesce(1)
    assert {r.output for r in assistants.generated(rows, Many, "s").collect()} == {"3:t0", "3:t1", "3:t2"}


def test_prompts_name_labels_and_examples():
    prompt = assistants.annotation_prompt(["title", "citation"], ["decision"], [("a", "<title>a</title>")])
    assert "<title>:" in prompt and "<citation>:" in prompt and "<decision>" in prompt and prompt.endswith("Answer:\n<title>a</title>")
    assert set(labels.SCHEME) == set(assistants.DEFINITIONS)
    with pytest.raises(ValueError, match="made up"):
        assistants.definitions(["made up"])
    assert "docid" in assistants.linking_prompt([("x", "y")])


# -- texts


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: T.final_channel(F.lit("to=a<|message|>x<|eot|>to=user<|message|> y\n<|eot|>to=user<|message|>z")), "z"),
        (lambda: T.final_channel(F.lit(" plain ")), "plain"),
        (lambda: T.normalized_docid(F.lit(" A &amp; B &lt;1&gt; &amp;amp; ")), "A & B <1> &amp;"),
        (lambda: T.normalized_docid(F.lit(None).cast("string")), None),
        (lambda: T.count_words(F.lit("it's a well-known naïve_x, 12 ok")), 7),
        (lambda: T.label_count(F.lit("<manual_label a><auto_label></auto_label><label>")), 2),
    ],
)
def test_token_functions(spark, column, want):
    assert one(spark, column()) == want


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b"", ("utf-8", "")), ("é".encode(), ("utf-8", "é")), (b"\xef\xbb\xbfx", ("utf-8-sig", "x")), ("é“".encode("utf-16"), ("utf-16", "é“")), (b"caf\xe9", ("iso-8859-1", "café")),
        (b"\x93caf\xe9\x94", ("windows-1252", "“café”")), (b'<meta charset="iso-8859-5">\xbf', ("iso-8859-5", '<meta charset="iso-8859-5">П')), (b"<meta charset=utf-8>\xe9", ("iso-8859-1", "<meta charset=utf-8>é")),
        (b"<meta charset=nonsense>\xe9", ("iso-8859-1", "<meta charset=nonsense>é")),
    ],
)
def test_charsets_are_found(data, want):
    assert readers.detected(data) == want


def test_files_in_any_charset_are_read(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("é“".encode("utf-16"))
    (tmp_path / "b.html").write_bytes(b"caf\xe9")
    assert {(r.charset, r.html) for r in readers.html_files_detected(spark, f"file://{tmp_path}").collect()} == {("utf-16", "é“"), ("iso-8859-1", "café")}


SPANS_HTML = '<body>x <manual_label labelname="Title" id="1">a</manual_label> a <manual_label labelname="title">a</manual_label> <auto_label labelname="source">b</auto_label></body>'


def test_spans_of_html_are_located_where_they_are_read(spark):
    """Nothing is brought together: rows hold their document's text, which would be moved once per span."""
    found = spans.located_spans(extraction.span_rows(spark.createDataFrame([("d", SPANS_HTML), ("e", None)], "doc_id string, html string")), "plain")
    assert [(r.seq, r.labelname, r.text, r.start_pos) for r in found.orderBy("seq").collect()] == [(0, "title", "a", 2), (1, "title", "a", 4), (2, "source", "b", 8)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_a_document_with_spans_is_one_row(spark):
    """Its text leaves the worker once, in batches of a bounded size."""
    docs = spark.createDataFrame([(str(i), SPANS_HTML.replace("</body>", " y" * 200_000)) for i in range(12)] + [("e", "<p>no label</p>")], "doc_id string, html string").coalesce(1)
    rows = extraction.document_spans(docs)
    assert sorted((r.doc_id, len(r.plain), [(x.seq, x.nth) for x in r.spans]) for r in rows.collect()) == sorted((str(i), len("x a a a b") + 400_000, [(0, 1), (1, 2), (2, 1)]) for i in range(12))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(8 << 20)


def test_span_texts_may_hold_any_characters(spark):
    rows = spark.createDataFrame([("d", 0, "title", "\\E.*\\Q", "a \\E.*\\Q b \\E.*\\Q"), ("d", 1, "title", "\\E.*\\Q", "a \\E.*\\Q b \\E.*\\Q"), ("d", 2, "title", "(x", "a \\E.*\\Q b \\E.*\\Q")], "doc_id string, seq int, labelname string, text string, plain string")
    assert [r.start_pos for r in spans.located_spans(rows, "plain").orderBy("seq").collect()] == [2, 11, -1]


# -- documents

HTML = (
    '<body><p>See <manual_label labelname="decision" parent="" docid="A &amp; B" id="1"><manual_label labelname="title">A v <i>B</i></manual_label>, <manual_label labelname="title">Other</manual_label>'
    ' <manual_label labelname="citation">[1999] 1</manual_label></manual_label> and <manual_label labelname="decision" parent="" docid="A & B" id="1"><manual_label labelname="citation">[1999] 2</manual_label></manual_label></p></body>'
)


def test_every_text_of_a_part_reaches_the_profile(spark):
    docs = spark.createDataFrame([("d", HTML)], "doc_id string, html string")
    p = registry.profiles(drivers.mention_table(docs).drop("html", "nth"), drivers.FIELDS).collect()
    assert [(r.docid, [x.value for x in r.titles], [x.value for x in r.citations]) for r in p] == [("A & B", ["A v B", "Other"], ["[1999] 1", "[1999] 2"])]


def test_ids_that_repeat_take_the_last_docid(spark):
    docs = spark.createDataFrame([("d", HTML.replace('"A & B"', '"C"') + '<p id="9" docid="x">')], "doc_id string, html string")
    assert {(r.id, r.docid) for r in extraction.docid_mapping(docs).collect()} == {("1", "C"), ("9", "x")}


def test_contexts_end_before_the_mention(spark):
    docs = spark.createDataFrame([("d", HTML)], "doc_id string, html string")
    rows = {r.mention_id: r.context for r in extraction.context_rows(docs, 3).collect()}
    assert rows[0] == "See " and rows[1] == " and "


def test_linking_examples_see_what_came_before(spark):
    docs = spark.createDataFrame([("d", HTML)], "doc_id string, html string")
    rows = {r.mention_id: (json.loads(r.input), r.output) for r in drivers.linking_examples(docs, 50).collect()}
    assert rows[0][0]["profiles"] == [] and [p["docid"] for p in rows[1][0]["profiles"]] == ["A & B"]
    assert rows[0][1].startswith('<decision docid="A &amp; B"><title>A v <i>B</i></title>') and rows[1][0]["mention"] == "<decision><citation>[1999] 2</citation></decision>"
    assert rows[1][0]["context"].startswith("See A v B, Other")


def test_extraction_examples_leave_long_inputs_out(spark):
    chunks = spark.createDataFrame([("d", '<manual_label labelname="title" style="x"> a</manual_label>'), ("e", "b" * 50)], "doc_id string, text string")
    got = drivers.extraction_examples(chunks, labels.Transform(remove_attrs=["style"]), 50).collect()
    assert [(r.source_file, r.input, r.output) for r in got] == [("d", " a", ' <manual_label labelname="title">a</manual_label>')]
    assert drivers.without_leaks(drivers.extraction_examples(chunks), F.lit("d")).count() == 1


def test_examples_of_profiles_hold_the_target(spark):
    rows = spark.createDataFrame([(f"P{i}",) for i in range(9)] + [(None,)], "docid string")
    for n in (1, 3, 20):
        got = [r.docid for r in drivers.example_profiles(rows, "P4", n, 1).collect()]
        assert "P4" in got and len(got) == min(n, 10)


def test_unresolved_counts_entities_without_text(spark):
    html = '<manual_label labelname="" parent="" docid="X">x</manual_label><manual_label labelname="decision" parent="" docid="Y">y</manual_label>'
    docs = spark.createDataFrame([("d", html)], "doc_id string, html string")
    pool = spark.createDataFrame([(0, "LEGISLATION", "zzz", "Z")], "row_idx long, doctype string, text string, title string")
    found = drivers.resolve(docs, pool)
    assert [(r.docid, r.score) for r in found.collect()] == [("Y", 0.0)]  # shares no term, and is resolved with score 0
    assert tuple(drivers.unresolved(docs, found, 0.5).first()) == (2, 1, 1, 2)


def test_preserved_documents():
    plain = "<p>a <i>b</i></p>"
    assert output.preserved('<p>a <i><auto_label x="1">b</auto_label></i></p>', plain) is None
    assert output.preserved("<p>a <i>b</i><i></i></p>", plain) is None  # tidying drops it
    assert output.preserved("<p>a b</p>", plain) == "tags differ" and output.preserved("<p>a <i>c</i></p>", plain) == "text differs at 2"


def test_docids_applied_report_missing_ids(spark):
    docs = spark.createDataFrame([("d", HTML), ("e", "<p>none</p>"), ("f", None)], "doc_id string, html string")
    maps = spark.createDataFrame([("d", "1", "new"), ("d", "5", "lost"), ("e", "0", "lost")], "doc_id string, id string, docid string")
    got = {r.doc_id: (r.html.count('docid="new"'), r.missing) for r in extraction.docids_applied(docs, maps).collect()}
    assert got == {"d": (2, ["5"]), "e": (0, ["0"]), "f": (0, [])}


# -- alignment, draws


def test_few_steps_in_long_texts_take_no_table():
    """A table of all cells would take 40 GB here."""
    want = [f"w{i % 7}" for i in range(100_000)]
    have = ["<auto_label>", *want[:3], "</auto_label>", *want[5:90_000], "z", *want[90_000:]]
    cost, ops = output.protected_alignment(want, have, lambda t: t.startswith("<"))
    got = output.applied(have, ops, lambda t: t.startswith("<"))
    assert cost == 5 and [t for t in got if not t.startswith("<")] == want and len(got) == len(want) + 2


def test_texts_are_aligned_like_their_tokens():
    rng = np.random.default_rng(3)
    parts = ["ab", "c", " ", "  ", "\n", ",", "<auto_label>", "</auto_label>", "<i>", "<", ">", "é"]
    for _ in range(3000):
        head, other, tail = ("".join(rng.choice(parts, rng.integers(0, 7))) for _ in range(3))
        a, b = head + tail, other + tail
        assert output.aligned_text(a, b) == "".join(output.aligned(output.tokenize(a), output.tokenize(b)))


def test_steps_near_the_diagonal_are_those_of_the_whole_table(monkeypatch):
    rng = np.random.default_rng(4)
    cases = [tuple([str(x) for x in rng.integers(0, k, rng.integers(0, 14))] for k in (4, 5)) for _ in range(400)]
    near = [output.protected_alignment(a, b, lambda t: t == "0") for a, b in cases]
    monkeypatch.setattr(output, "NEAR", 0)
    assert near == [output.protected_alignment(a, b, lambda t: t == "0") for a, b in cases]


@pytest.mark.parametrize("n", [1, 12, 1003])
def test_draws_are_those_of_the_hash(n):
    codes, values = (np.arange(n) % 50).astype(np.uint8), np.array([np.arange(50), np.arange(50) ** 3])
    got = stats.drawn_sums(np.arange(8, 102), codes, values, 42)
    for b in range(8, 102):
        at = [int(hashlib.md5(f"{b}|{i}|42".encode()).hexdigest()[:8], 16) % n for i in range(n)]
        assert got[:, b - 8].tolist() == values[:, codes[at]].sum(1).tolist()


def test_replicates_are_summed_where_they_are_drawn(spark):
    docs = spark.createDataFrame([(i, i % 3, 4, i % 5) for i in range(30)], "doc_id long, tp long, n_gold long, n_system long")
    plan = stats.bootstrap_f1(docs, 50)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert stats.bootstrap_f1(docs.where("false"), 50).count() == 1


# -- tables, files, streams


def test_numbers_follow_the_order_over_many_files(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = readers.numbered(rows, "k").collect()
    assert sorted((r.k, r.n) for r in got) == [(i, i + 1) for i in range(1000)]
    assert [r.k for r in readers.sliced(rows, "k", 998).orderBy("k").collect()] == [997, 998, 999]


def test_links_are_written_as_files(spark, tmp_path):
    rows = spark.createDataFrame([("d", 0, "A"), ("d", 1, None), ("d", 2, "A")], "doc_id string, mention_id int, docid string")
    sinks.write_links(rows, f"file://{tmp_path}/out")
    assert json.loads((tmp_path / "out/d_coref_mapping.json").read_text()) == {"0": "A", "2": "A"}
    assert sorted(json.loads((tmp_path / "out/d_coref_clusters.json").read_text())) == [["0", "2"], ["1"]]
    assert sorted((r.stem, r.mention_id) for r in readers.cluster_files(spark, f"file://{tmp_path}/out/*_coref_clusters.json").collect()) == [("d", "0"), ("d", "1"), ("d", "2")]


def test_small_scans_are_spread(spark, tmp_path):
    path = f"file://{tmp_path}/one"
    spark.range(100).coalesce(1).write.parquet(path)
    assert staging.spread(spark.read.parquet(path)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    rows = spark.range(10)
    assert staging.spread(rows) is rows


def test_sessions_of_a_table(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 02:00:00")], "user_id long, ts string")
    assert sorted((r.n, str(r.start)) for r in rates.sessions(rows).collect()) == [(1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:00:00")]


@pytest.mark.parametrize("n", [0, 40])
def test_streams_read_tables_of_many_files(spark, tmp_path, n):
    rows = spark.createDataFrame([(i % 4, i, "ab"[i % 2]) for i in range(n)], "conv_id long, turn long, role string")
    rows.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.doc_id, r.docid): (r.first_seen_id, r.n_mentions) for r in more.FOUND["stream_growing_profiles"](spark, str(tmp_path)).collect()}
    assert got == {(i, "ab"[i % 2]): (i, 10) for i in range(4 if n else 0)}


def test_registries_in_both_forms(spark):
    older = {"profiles": [{"doc_type": "decision", "docid": "D", "alternative_titles": ["T1", "T2"], "citations": {"c": "3", "d": None}, "fragments_mentioned": {}, "authors": None, "first_seen_id": "3"}]}
    p, v = registry.from_json(spark.createDataFrame([("x", json.dumps(older))], "doc_id string, registry string"))
    assert [(r.docid, r.main_title, r.first_seen_id) for r in p.collect()] == [("D", "T1", 3)]
    assert {(r.field, r.value, r.first_seen_id, r.ord) for r in v.collect()} == {("title", "T1", None, 1), ("title", "T2", None, 2), ("citation", "c", 3, 1), ("citation", "d", None, 2)}


def test_typed_queries_without_a_type(spark):
    pool = spark.createDataFrame([(0, "red fox", None), (1, "red hen", "A")], "row_idx int, text string, doctype string")
    q = spark.createDataFrame([(1, "red", None), (2, "red", "A"), (3, "", "A")], "qid int, qtext string, qtype string")
    got = {(r.qid, r["rank"]): r.row_idx for r in retrieval.bm25_topk_by_type(pool, q, 2, "qid").collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (2, 1): 1, (3, 1): 1}
