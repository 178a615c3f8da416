"""Queries over made markup against their SQL, for texts whose first line is blank, null or full of signs."""

import duckdb
import pytest

from quarry import catalog_queries
from quarry.operators import parsing
from tests.test_entry import shown

TEXTS = (
    "", "\nsecond line", "   ", "$$$", "\t x  y \t", "plain line of more than twenty characters", "a -- dash --- and ``q'' `r' it''s ~ end {b} \\emph{c} \\% of", "# a heading of some words", "## two", "a\r", "x ", "  lead and more words for it", "![cap](img.png) in the line",
    "| a | b |", "\x0cfeed \x1fend\x85", "u v  ", None, "\\begin{equation}x\\end{equation}", "exactly twenty chars", "nineteen characters", "```code", "- - -", "} unbalanced {", "\\", "Abstract", "% comment", "\\section{Other}",
)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, ("en", "fr")[i % 2], f"src{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["full_texts", "latex_sections", "markdown_documents", "latex_elements"])
def test_lines_of_any_kind(spark, odd, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    got, want = catalog_queries.queries()[name](spark, odd).toPandas(), con.sql(catalog_queries.oracle_sql()[name]).df()
    got, want = (shown(df.astype(object).where(df.notna(), None)).astype(str) for df in (got, want))
    assert got.values.tolist() == want[list(got.columns)].values.tolist()


def test_an_empty_abstract_ends_at_the_next_heading():
    for gap in ("", "\n", "\n\n"):
        d = parsing.parse_markdown("p", f"# Title\n\n## Abstract\n{gap}## Intro\nA paragraph that is long enough here.\n\n## Next\nmore\n")
        assert d["abstract"] == "" and [s["title"] for s in d["sections"]] == ["Intro", "Next"]
