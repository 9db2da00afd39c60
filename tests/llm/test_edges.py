"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skarn.llm import bpe, decontam, html, langid, licenses, pii, quality, shards, simhash, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the of and it is was for with by that " * 20_000
ROWS = [
    (1, None, "en", "a", None),
    (2, "", "en", None, 0),
    (3, " \n\t ", None, "a", 4),
    (4, "The nation and the others of it", "en", "a", 31),
    (4, "The nation and the others of it", "en", "a", 31),
    (5, "The nation and the others of it", "en", "a", 31),
    (None, "un deux trois quatre cinq six", "fr", "b", 29),
    (None, None, None, None, None),
    (6, LONG, "en", "a", len(LONG)),
    (7, "x" * 200_000, "en", "a", 200_000),
    (8, "12345 !!! \x00 \x1c 日本語 ½ <|endoftext|>", "de", "a", 30),
]
ITEMS = [(1, "un deux trois quatre cinq six"), (2, None), (3, ""), (4, "others of"), (4, "others of")]
#: Names that operators use inside.
CLASH = ("fp", "v", "cls", "node", "root", "a", "b", "_keep", "_hit", "_rejected", "fingerprint", "component_id", "spans", "ids", "votes", "n", "kept", "path", "key", "block", "word", "draw", "first", "host", "rule", "size", "item_id", "shard", "start", "lang_pred", "score", "dir", "up", "license", "blocked", "label", "prediction", "features", "key_", "k_", "d_", "r_", "row_", "rows_", "band", "bands", "signature")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def operators(items, model):
    return {
        "bpe": lambda d: bpe.encode(d, public_tokenizers.path("word_bpe_49k.json")),
        "langid": lambda d: langid.identify(d, model),
        "keep_identified": lambda d: langid.keep_identified(d, model),
        "pii": pii.find,
        "redact": pii.redact,
        "shards": lambda d: shards.read_shards(shards.write_shards(d, public_tokenizers.path("byte_bpe_50k.json"))),
        "quality": quality.judge,
        "decontam": lambda d: decontam.contained_items(d, items),
        "decontaminated": lambda d: decontam.decontaminated(d, items),
        "simhash": simhash.near_duplicates,
        "keep_first": simhash.keep_first,
        "licenses": lambda d: licenses.scan(d.select("doc_id", "text", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), *[c for c in d.columns if c not in ("doc_id", "text", "path")])),
    }


@pytest.mark.parametrize("most", [1 << 23, 0])
def test_decontamination_both_ways(docs, items, operators, monkeypatch, most):
    """A benchmark in one block and one joined by shuffles have the same defined results."""
    monkeypatch.setattr(decontam, "BLOCK_BYTES", most)
    hits = sorted((r.doc_id or 0, r.item_id) for r in operators["decontam"](docs).collect())
    assert hits == [(0, 1), *[(4, 4)] * 4, *[(5, 4)] * 2]
    more = docs.withColumns({c: F.lit("?") for c in (*CLASH, "key_", "dkey", "ikey", "width", "value")})
    assert sorted(r.doc_id or 0 for r in operators["decontaminated"](more).collect()) == [0, 1, 2, 3, 6, 7, 8]
    assert operators["decontaminated"](docs.limit(0)).count() == operators["decontam"](docs.limit(0)).count() == 0
    assert decontam.decontaminated(docs, items.limit(0)).count() == len(ROWS)


NAMES = ["bpe", "langid", "keep_identified", "pii", "redact", "shards", "quality", "decontam", "decontaminated", "simhash", "keep_first", "licenses"]


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", NAMES)
def test_extra_and_clashing_columns_change_nothing(docs, operators, name):
    plain = operators[name](docs)
    more = operators[name](docs.withColumns({c: F.lit("?") for c in CLASH if c not in docs.columns and (name != "licenses" or c != "path")}))
    assert rows(plain) == rows(more.select(*plain.columns))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, operators, name):
    assert operators[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["bpe", "langid", "pii", "redact", "shards", "quality", "simhash", "licenses"])
def test_one_row_for_each_row(docs, operators, name):
    found = operators[name](docs)
    assert sorted(r[0] or 0 for r in found.select("doc_id").collect()) == sorted(r[0] or 0 for r in ROWS)


def test_defined_results(docs, operators):
    tags = {r.doc_id: r.lang_pred for r in operators["langid"](docs).collect()}
    assert tags[1] == tags[2] == tags[3] == "und" and tags[4] == tags[6] == "en" and tags[8] != "und"
    kept = [r.doc_id for r in operators["keep_identified"](docs).collect()]
    assert not {1, 2, 3} & {*kept} and {4, 5, 6, 7, 8} <= {*kept}
    comps = {r.doc_id: r for r in operators["simhash"](docs).collect()}
    assert comps[1].fingerprint == 0 and comps[1].component_id == comps[3].component_id == 1 and comps[5].component_id == 4
    assert sorted(r.doc_id or 0 for r in operators["keep_first"](docs).collect()) == [0, 1, 4, 6, 7, 8]
    hits = sorted((r.doc_id or 0, r.item_id) for r in operators["decontam"](docs).collect())
    assert hits == [(0, 1), *[(4, 4)] * 4, *[(5, 4)] * 2]
    assert sorted(r.doc_id for r in operators["decontaminated"](docs).collect() if r.doc_id) == [1, 2, 3, 6, 7, 8]
    kept = {r.doc_id: r for r in operators["quality"](docs).collect()}
    assert kept[1].n_words == kept[3].n_words == 0 and kept[6].n_words == 200_000 and kept[6].n_repeat_words == 200_000


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "http://A.Com?x#y", "<p>hi"), (3, "http://A.Com?x#y", "<p>hi"), (None, "no scheme", "<b>" * 5000 + "x"), (4, "ftp://u/" + "a/" * 50_000, "<td>a</table>")], "page_id long, url string, html string")
    texts = [(r.page_id, r.text) for r in html.extract(pages).collect()]
    assert texts == [(1, ""), (2, ""), (3, "hi"), (3, "hi"), (None, "x"), (4, "a")]
    clash = html.extract(pages.withColumns({c: F.lit("?") for c in (*CLASH, "text")}))
    assert clash.columns == ["page_id", "text"] and [(r.page_id, r.text) for r in clash.collect()] == texts
    rules = urls.parse_rules("allow com/, block u/")
    found = {r.page_id: r for r in urls.judge(pages.withColumns({c: F.lit(1) for c in CLASH}), rules).collect()}
    assert (found[1].host, found[1].path, found[None].host) == ("", "", "") and found[3].host == "a.com" and found[3].path == "" and found[3].rule is None
    assert (found[4].rule, found[4].verdict) == ("u/", "block")
    assert html.extract(pages.limit(0)).count() == 0 and urls.judge(pages.limit(0), rules).count() == 0


def test_keep_first_by_row(spark):
    """Null doc_ids, and one doc_id for different texts, lose no component; the choice does not depend on the order."""
    far = ["one two three four five six", "quick brown foxes jump over lazy dogs", "nothing in common with the others here"]
    rows = [(None, far[0]), (None, far[1]), (None, far[1].upper()), (7, far[2]), (7, far[0] + " and more of it"), (3, far[2]), (9, None), (None, ""), (5, "same id"), (5, "Same  ID"), (5, "same id")]
    key = lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0]
    told = [(None, far[0]), (None, min(far[1], far[1].upper(), key=key)), (7, far[0] + " and more of it"), (3, far[2]), (9, None), (5, min("same id", "Same  ID", key=key))]
    for order in (rows, rows[::-1]):
        got = [(r.doc_id, r.text) for r in simhash.keep_first(spark.createDataFrame(order, "doc_id long, text string")).collect()]
        assert sorted(got, key=str) == sorted(told, key=str)
