from papyrine import plans
from papyrine.session import table


def test_repairs_reach_the_whole_abstract(spark, small, tmp_path):
    """Artefacts beyond the 60th character are put right, and nothing of the text is left out."""
    text = "We study graphs. " * 8 + "A condition- ing of $\\beta$ [4, 5] holds (Lee et al., 2024). The last word is zymurgy."
    papers = table(spark, small, "papers").where("event_id is not null").limit(1)
    papers.withColumns({"abstract": papers["title"]}).selectExpr(*[f"'{text}' as abstract".replace("\\", "\\\\") if c == "abstract" else c for c in papers.columns]).write.parquet(str(tmp_path / "papers.parquet"))
    fixed = [r.fixed for r in plans.queries()["text_repairs"](spark, str(tmp_path)).collect()]
    assert fixed and all(f == "We study graphs. " * 8 + "A conditioning of β holds. The last word is zymurgy. conditioning token-level α end" for f in fixed)
