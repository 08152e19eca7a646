"""Formatting, lead sentences, summaries, template answers, fingerprint."""

from pyspark.sql import functions as F

from leadlens.functions.fmt import money0, one_decimal, percent1
from leadlens.operators import answer as A
from leadlens.operators.chunks import lead_text, summary_chunks, summary_figures
from leadlens.operators.fingerprint import fingerprint, text_fingerprint


def test_python_style_formats(spark):
    vals = [82.25, 0.125, 2.675, 1234567.5, 99.95, -3.45]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = df.select(money0(F.col("v")).alias("a"), one_decimal(F.col("v")).alias("b"),
                    percent1(F.col("v") / 100).alias("c")).collect()
    for v, r in zip(vals, got):
        assert r["a"] == f"{v:,.0f}" and r["b"] == f"{v:.1f}"


def test_lead_sentence_golden(spark):
    row = dict(company_size="Large", industry="Tech", region="Europe", annual_revenue=54321.5,
               engagement_score=82.25, website_visits=30, email_opens=8, ad_clicks=5, lead_source="Organic",
               previous_purchases=2, predicted_lead_score="High", confidence=0.9, probability_high=0.9)
    df = spark.createDataFrame([row])
    text = df.select(lead_text(df).alias("t")).first()["t"]
    assert text == ("This lead is a Large company in the Tech industry. Region: Europe Annual Revenue: $54,322 "
                    "Engagement Score: 82.2/100 Website Visits: 30 Email Opens: 8 Ad Clicks: 5 Lead Source: Organic "
                    "Previous Purchases: 2 Predicted Lead Score: High quality Prediction Confidence: 90.0% "
                    "Probability of High Quality: 90.0%")


def test_lead_sentence_nulls_default_and_compat(spark):
    df = spark.createDataFrame([(None, "Tech", "Asia", None)],
                               "company_size string, industry string, region string, annual_revenue double")
    default = df.select(lead_text(df).alias("t")).first()["t"]
    compat = df.select(lead_text(df, compat=True).alias("t")).first()["t"]
    assert default == "This lead is a company company in the Tech industry. Region: Asia"
    # positional skip drops Region when size is missing (original behaviour)
    assert compat == "This lead is a nan company in the Tech industry. "


def test_summary_order_and_shares(spark):
    rows = [("High", "Tech", "Asia", 10.0, 50.0), ("Low", "Tech", "Europe", 30.0, 70.0),
            ("Low", None, "Asia", None, None), ("Medium", "Retail", "Asia", 20.0, 60.0)]
    df = spark.createDataFrame(rows, "predicted_lead_score string, industry string, region string, "
                                     "annual_revenue double, engagement_score double")
    got = [r["text"] for r in summary_chunks(df).orderBy(F.col("index").cast("int")).collect()]
    assert got == ["Total leads analyzed: 4", "2 leads (50.0%) are predicted as Low quality",
                   "1 leads (25.0%) are predicted as High quality", "1 leads (25.0%) are predicted as Medium quality",
                   "Top industries: Tech (2), Retail (1)", "Average annual revenue: $20, Maximum: $30",
                   "Average engagement score: 60.0/100", "75.0% of leads are from Asia", "25.0% of leads are from Europe"]


def test_summary_reads_the_table_once(spark, tmp_path):
    df = spark.createDataFrame([(None, None, 1.0)], "industry string, region string, engagement_score double")
    got = lambda d: [r["text"] for r in summary_chunks(d).orderBy(F.col("index").cast("int")).collect()]
    assert got(df) == ["Total leads analyzed: 1", "Top industries: ", "Average engagement score: 1.0/100"]
    assert got(df.where("false").select("region")) == ["Total leads analyzed: 0"]
    assert got(df.select(F.lit(1).alias("x"))) == ["Total leads analyzed: 1"]
    df.write.parquet(str(tmp_path / "t"))
    plan = summary_figures(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "Window" not in plan


def test_template_routing(spark):
    ctx = "Relevant Information:\n\n1. a Tech industry lead\n\n2. revenue line\n\n"
    cases = [("Which are the TOP leads?", ctx, A.ANSWER_HIGH),
             ("stop", "nothing here", A.ANSWER_HIGH_FALLBACK),          # substring match
             ("industry mix?", ctx, "Based on the data:\n1. a Tech industry lead"),
             ("industry mix?", "none", A.FALLBACK_INDUSTRY),
             ("revenue?", ctx, "Revenue information:\n2. revenue line"),
             ("engagement?", ctx, A.FALLBACK_ENGAGEMENT),
             ("hello", ctx, A.DEFAULT_PREFIX + ctx[:200] + A.DEFAULT_SUFFIX)]
    df = spark.createDataFrame([(q, c) for q, c, _ in cases], "q string, c string")
    got = [r["a"] for r in df.select(A.template_answer(F.col("q"), F.col("c")).alias("a")).collect()]
    assert got == [e for _, _, e in cases]


def test_fingerprint_order_invariant_and_sensitive(spark):
    rows = [(i, float(i) / 3, f"s{i % 4}") for i in range(200)]
    a = spark.createDataFrame(rows, "k long, x double, s string")
    b = spark.createDataFrame(list(reversed(rows)), "k long, x double, s string").repartition(5)
    assert fingerprint(a).first() == fingerprint(b).first()
    changed = rows[:]
    changed[17] = (17, 17 / 3 + 1e-3, "s1")
    assert fingerprint(spark.createDataFrame(changed, "k long, x double, s string")).first() != fingerprint(a).first()
    dup = spark.createDataFrame(rows + rows[:2], "k long, x double, s string")
    assert fingerprint(dup).first() != fingerprint(a).first()


def test_fingerprints_see_moved_text_nulls_and_last_bits(spark):
    def both(rows, schema="a string, b string"):
        df = spark.createDataFrame(rows, schema)
        return fingerprint(df).first(), text_fingerprint(df).first()

    cases = [[("a|b", "c")], [("a", "b|c")], [("\\N", "c")], [(None, "c")], [("", "c")], [("-", "c")], [("c", None)], [("ab", "c")], [("a", "bc")]]
    for kind in (0, 1):
        seen = [both(rows)[kind] for rows in cases]
        assert len(set(seen)) == len(cases)
        numbers = [both([(x, "k")], "a double, b string")[kind] for x in (1.0, 1.0 + 3e-7, 1.0 + 2 ** -52, 1e33, 1e33 * (1 + 2 ** -52), -2.5, None, float("nan"))]
        assert len(set(numbers)) == len(numbers)
