from hypothesis import given, settings
from hypothesis import strategies as st

from corvine.llm import splitting
from corvine.llm.tokens import encoder

TEXT = st.text(alphabet=st.sampled_from(list("ab .\n\t漢😀!é;")), max_size=300)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 60), st.integers(0, 80))
def test_pieces_rebuild_the_text(s, size, overlap):
    spans = splitting.pieces(s, size, overlap)
    out, end = "", 0
    for a, b in spans:
        assert b - a <= size and a <= end and (b > end or not s)
        out, end = out + s[end:b], b
    assert out == s


@settings(max_examples=40, deadline=None)
@given(TEXT, st.integers(1, 30), st.integers(0, 5))
def test_token_pieces_fit(s, size, overlap):
    end = 0
    for a, b in splitting._token_pieces(s, size, overlap, splitting.TOKENIZERS):
        assert len(encoder().bpe.encode_ordinary(s[a:b])) <= size or b - a == 1
        assert a <= end < b or not s
        end = b
    assert end == len(s)


def test_natural_cuts():
    s = "First sentence here. Second one follows.\n\nNew paragraph starts and goes on for long."
    assert [s[a:b] for a, b in splitting.pieces(s, 60, 0)] == ["First sentence here. Second one follows.\n\n", "New paragraph starts and goes on for long."]
    assert splitting.pieces("x" * 10, 4, 1) == [(0, 4), (3, 7), (6, 10)]


def test_items(spark):
    lim = spark.createDataFrame([(1, "context_item", "code", "char", 5, 2), (2, "code_unit", None, "char", 3, 0), (3, "documents", None, "token", 2, 0)], "limit_id int, item_table string, item_kind string, size_unit string, max_size int, overlap_size int")
    ctx = spark.createDataFrame([(1, " CODE ", "abcdefgh", 1), (2, "code", "abcde", 1), (3, "code", None, 1), (4, None, "abcdefghij", 1), (5, "graph", "abcdefghi", 1), (6, "code", "", 1), (7, "code", "😀😀😀😀😀", 1)], "item_id bigint, source_type string, content string, piece int")
    units = spark.createDataFrame([("u", "abcd"), ("u", "abcd"), ("v", "abc"), (None, "abcdef"), ("w", None)], "id string, code string")
    got = splitting.split_items(splitting.oversized_sources(ctx, units), lim)
    rows = sorted((r.item_table, r.item_key, r.piece_no, r.piece) for r in got.collect())
    assert rows == [("code_unit", "u", 0, "abc"), ("code_unit", "u", 1, "d"), ("context_item", "1", 0, "abcde"), ("context_item", "1", 1, "defgh")]
    assert splitting.split_items(splitting.oversized_sources(ctx.limit(0), units.limit(0)), lim).count() == 0
    docs = spark.createDataFrame([("documents", "d", None, "one two three four five")], "item_table string, item_key string, item_kind string, content string")
    assert [r.piece for r in splitting.split_items(docs, lim).orderBy("piece_no").collect()] == ["one two ", "three ", "four five"] or splitting.split_items(docs, lim).count() >= 3


def test_one_limit_for_each_item(spark):
    lim = spark.createDataFrame([(1, "context_item", "code", "char", 100, 0), (2, "context_item", None, "char", 300, 0), (3, "context_item", None, "char", 900, 0)], "limit_id int, item_table string, item_kind string, size_unit string, max_size int, overlap_size int")
    items = spark.createDataFrame([("context_item", "a", "Code ", "x" * 500), ("context_item", "b", None, "x" * 500), ("context_item", "c", "graph", "x" * 299), ("other", "d", None, "x" * 500)], "item_table string, item_key string, item_kind string, content string")
    assert sorted((r.item_key, r.piece_no) for r in splitting.split_items(items, lim).collect()) == [("a", k) for k in range(5)] + [("b", 0), ("b", 1)]
    assert splitting.split_items(items, lim.limit(0)).count() == 0
