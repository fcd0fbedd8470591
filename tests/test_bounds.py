"""What bounds the tasks that write and read the index: pieces of batches, no shuffle of arrays, no token rows on the way to vertical files."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from corpusloom.operators import blocks, index, snippets
from corpusloom.plans import annotated
from corpusloom.plans.query import Searcher
from corpusloom.sources import tokens as T


def test_batches_are_cut_into_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["ab", None, "c" * 9, "", "d", "ef", "g"])], names=["doc_id", "text"])
    cut = list(T.pieces(iter([batch]), "text", 4))
    assert [x.column("doc_id").to_pylist() for x in cut] == [[0, 1], [2], [3, 4, 5, 6]]
    cut = list(T.pieces(iter([pa.RecordBatch.from_arrays([pa.array([[1, 2], [3], None, [4]])], names=["a"])]), "a", 2))
    assert [len(x) for x in cut] == [1, 3]


def test_words_and_blocks_work_on_pieces(monkeypatch):
    seen = []
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(["w " * 20] * 300), pa.array(["w " * 20] * 300)], names=["doc_id", "text", "lower"])
    monkeypatch.setattr(T, "PIECE_BYTES", 400)
    for b in T._words(iter([batch])):
        seen.append(len(b))
    assert max(seen) == 10 and sum(seen) == 300


def test_vertical_files_are_made_without_shuffling_tokens(spark):
    docs = spark.createDataFrame([(i, "One two. Three four five. " * i) for i in range(20)], "doc_id long, text string")
    plan = T.vertical_texts(annotated.annotated(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_lines_become_documents_without_shuffling_texts(spark, tmp_path):
    (tmp_path / "a.vert").write_text("\n".join(["head"] + [x for i in range(30) for x in (f"%%#DOC\t{i}", "%%#SEN 1 wx1", "0\tw")]) + "\n")
    lines = T.vertical_lines(spark, str(tmp_path))
    found = T.vertical_tokens(lines).where("not is_mark").select("doc_id", "pos", "token", "tag").orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(i, 1, "w", None) for i in range(30)]
    plan = T.vertical_arrays(lines)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_documents_lie_in_the_buckets_of_their_parts(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a b{i}") for i in range(700)], "doc_id long, text string")
    path = str(tmp_path / "i")
    index.write_index(docs, path, ["token", "lower"], 700, T.plain_documents)
    stored = index.StoredIndex(spark, path)
    beside = stored.tokens_with(["token"]).groupBy("part", "doc_id").agg(F.count("*").alias("n"))
    assert "Exchange" not in beside._jdf.queryExecution().executedPlan().toString()
    assert {r.n for r in beside.collect()} == {2} and blocks.KEY == ["part", "doc_id"]


def test_documents_lie_in_small_row_groups(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a b{i}") for i in range(3000)], "doc_id long, text string").coalesce(1)
    index.write_index(docs, str(tmp_path / "i"), ["token", "lower"], 3000, T.plain_documents, ordered=True)
    meta = [pq.ParquetFile(f).metadata for f in (tmp_path / "i" / "1" / "documents").glob("*.parquet")]
    groups = [m.row_group(g).num_rows for m in meta for g in range(m.num_row_groups)]
    assert sum(groups) == 3000 and max(groups) <= 256


def test_ordered_rows_make_the_same_index_without_a_shuffle(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a b{i % 7} a") for i in range(700)], "doc_id long, text string").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    found = []
    for ordered in (False, True):
        path = str(tmp_path / str(ordered))
        index.write_index(docs, path, ["token", "lower"], 700, T.plain_documents, ordered=ordered)
        stored = index.StoredIndex(spark, path)
        hits = stored.hits([("lower", "a", False), ("lower", "b3", False)])
        found.append((sorted(map(tuple, stored.terms.collect())), sorted(map(tuple, hits.collect()))))
    assert found[0] == found[1] and len(found[0][1]) == 1500


def test_intervals_share_one_row_of_their_document(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b " * 5) for i in range(20)], "doc_id long, text string")
    index.write_index(docs, str(tmp_path / "i"), ["token", "lower"], 20, T.plain_documents)
    stored = index.StoredIndex(spark, str(tmp_path / "i"))
    found = Searcher(stored).search("a", "lower")
    rows = stored.beside(found, ["token"]).collect()
    assert len(rows) == 20 and {len(r.found) for r in rows} == {5}
    shown = snippets.plain_snippets(found, stored, 1).where("doc_id = 3").orderBy("l").collect()
    assert [(r.l, r.snippet) for r in shown] == [(0, "a b"), (2, "b a b"), (4, "b a b"), (6, "b a b"), (8, "b a b")]


def test_paragraphs_are_made_without_token_rows(spark):
    docs = spark.createDataFrame([(1, [1, 1, 1, 2, 2], ["§", "a|G__", "b", "§", "c"]), (2, [1], ["¶"]), (3, [], [])], "doc_id long, par_no array<long>, token array<string>")
    found = snippets.paragraphs(docs)
    assert sorted(map(tuple, found.collect())) == [(1, 1, "a b"), (1, 2, "c")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_vertical_files_are_made_by_one_worker_a_task(spark):
    docs = spark.createDataFrame([(i, "One Two. Three four|x Five.\nsix " * i if i != 7 else None) for i in range(20)], "doc_id long, text string")
    found, steps = annotated.vertical(docs), T.vertical_texts(annotated.annotated(docs))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, steps.collect()))
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert (count(found), count(steps)) == (1, 3)


def test_blocks_of_a_piece_come_in_order(spark):
    docs = spark.createDataFrame([(i, f"b{i % 7} a z{i} B") for i in range(40)], "doc_id long, text string").coalesce(1)
    documents = T.plain_documents(docs).withColumn("part", F.shiftright("doc_id", 4))
    found = [(r.field, r.term, r.part) for r in blocks.block_rows(documents, ["token", "lower"]).collect()]
    assert found == sorted(found) and {f for f, _, _ in found} == {"_SENT_", "lower", "token"}


def test_postings_are_written_without_a_sort(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"b{i % 7} a") for i in range(40)], "doc_id long, text string")
    index.write_index(docs, str(tmp_path / "i"), ["token", "lower"], 40, T.plain_documents)
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {index._name(str(tmp_path / 'i'), 1, 'postings')}").collect()}
    assert told.get("Sort Columns", "[]") == "[]"


def test_dictionary_is_made_by_one_worker_a_task(spark, tmp_path):
    docs = spark.createDataFrame([(i, "One two|x Two. two " * i if i != 7 else None) for i in range(20)], "doc_id long, text string")
    found, steps = index.term_stats(docs, "lower"), index.term_stats(T.plain_documents(docs), "lower")
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, steps.collect()))


def test_cells_are_cut_without_a_copy():
    lines = ["a\tb\t", "", "\t", "é\tc"]
    for a in (pa.array(lines), pa.array(["x\ty", *lines]).slice(1)):
        n, cells = T._cells(a)
        flat = iter(cells.take(pa.array(range(0, len(cells), 2))).to_pylist())
        assert [[next(flat) for _ in range(k)] for k in n] == [x.split("\t") for x in lines]


def test_an_index_of_vertical_text_has_what_its_queries_name(spark, tmp_path):
    spark.createDataFrame([(i * 5, "Anna went. To Parma with Clara now " * (i % 4)) for i in range(30)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    stored = annotated.searched(spark, str(tmp_path), "(person.gender:M < nertag:location) - _PAR_", ["position"])
    assert (stored.names, sorted(stored.columns)) == (["nertag", "param3"], ["nertag", "par_no", "param3", "position"])
    assert annotated.texts(spark, str(tmp_path)).where(F.startswith("head", F.format_string("%%%%#DOC\t%d\n", F.col("doc_id") * 5))).count() == 30


def test_paragraphs_and_snippets_are_made_in_the_worker_that_reads_texts(spark, tmp_path):
    spark.createDataFrame([(i, "Anna went. To Parma with Clara now " * (i % 4)) for i in range(30)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("paragraph_snippets", "entity_merge", "vertical_fields"):
        plan = annotated.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1
    made = annotated.Made(spark, str(tmp_path))
    found = spark.createDataFrame([(3, 3, 5), (3, 0, 0), (7, 4, 4)], "doc_id long, l int, r int")
    whole = {(r.doc_id, r.pos): r.token for r in annotated.vertical_tokens(spark, str(tmp_path)).collect()}
    cut = [(r.doc_id, r.l, r.r, r.pos, r.token) for r in made.cut(found, 2, ["token", "mention"]).collect()]
    assert sorted(cut) == sorted((d, l, r, p, whole[d, p]) for d, l, r in ((3, 3, 5), (3, 0, 0), (7, 4, 4)) for p in range(max(l - 2, 0), r + 3))
