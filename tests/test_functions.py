from decimal import Decimal as D

from pyspark.sql import functions as F

from khata.functions import dates, ids, itc, score, tax, texts

from .conftest import rows


def values(spark, column, data, schema="x string"):
    return [r[0] for r in spark.createDataFrame(data, schema).select(column).collect()]


def test_identifiers(spark):
    x = F.col("x")
    assert values(spark, ids.normalize_id(x), [(" ab-1/2 ",), (None,)]) == ["AB12", ""]
    assert values(spark, ids.duplicate_key(x), [(" ab-1 ",), (None,)]) == ["AB-1", ""]
    assert values(spark, ids.number_prefix(x), [("OMH26061005",), (None,)]) == ["OMH", ""]
    assert values(spark, ids.state_of_gstin(x), [("29ABC",), ("X9",), (None,)]) == ["29", "", ""]
    got = values(spark, ids.routing_prefix(F.lit("CR001"), x), [("note (against MH0000201)",), ("no original",)])
    assert got == ["MH", "CR"]
    assert values(spark, ids.resolve_pos(x, F.lit("27A"), "06"), [("29-KA",), (None,), ("Delhi",)]) == ["29", "27", "27"]


def test_known_place_of_supply(spark):
    got = values(spark, ids.known_place_of_supply(F.col("x")), [("27",), ("27-Maharashtra",), ("goa",), ("",), ("25",), ("Mars",)])
    assert got == [True, True, True, True, False, False]


def test_fuzzy_numbers(spark):
    pairs = [("SI2024001", "2024001", True), ("0001", "1", True), ("ABC", "ABCD", False), ("A1234", "A1234", False),
             ("", "1", False), ("000", "0", False), ("X2024", "Y2025", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in df.select(ids.fuzzy_same_number(F.col("a"), F.col("b")), "want").collect())


def test_substrings_cover_every_piece(spark):
    got = values(spark, ids.substrings(F.col("x")), [("ABCDEF",), ("ABC",)])
    assert sorted(got[0]) == sorted(["ABCD", "BCDE", "CDEF", "ABCDE", "BCDEF", "ABCDEF"]) and got[1] == []


def test_dates(spark):
    x = F.col("x")
    data = [("05-Jan-2024",), ("5/1/2024",), ("2024-01-05",), ("05-01-2024",), ("05 January 2024",), ("31-02-2024",), ("bad",), (None,)]
    assert values(spark, dates.gst_date(x), data) == ["05-01-2024"] * 5 + ["31-02-2024", "", ""]
    assert values(spark, dates.in_period(x, "2024-01"), [("05-01-2024",), ("05-02-2024",), ("x",), (None,)]) == [True, False, False, False]
    assert values(spark, dates.fiscal_month_index(F.to_date(x)), [("2026-04-01",), ("2026-06-30",), ("2026-03-01",)]) == [1, 3, 12]
    assert values(spark, dates.period_folder(F.to_date(x)), [("2026-06-30",)]) == ["3. June 2026"]
    assert values(spark, dates.voucher_to_iso(x), [("20240105",), ("2024",), ("2024990x",)]) == ["2024-01-05", "2024", "2024990x"]
    assert values(spark, dates.iso_to_voucher(x), [("2024-01-05T10:00",), ("x",)]) == ["20240105", None]


def test_rates(spark):
    data = [(D("180.00"), D("1000.00"), 18.0), (D("0"), D("1000"), 0.0), (D("90"), D("1000"), 7.5), (D("-5"), D("100"), 0.0),
            (D("10"), D("0"), 0.0), (D("999"), D("1000"), 28.0), (D("90.00"), D("2000.00"), 5.0)]
    df = spark.createDataFrame(data, "t decimal(18,2), b decimal(18,2), want double")
    assert all(a == b for a, b in df.select(tax.nearest_rate(F.col("t"), F.col("b")), "want").collect())
    tie = spark.createDataFrame([(D("85"), D("1000"))], "t decimal(18,2), b decimal(18,2)")
    assert tie.select(tax.nearest_rate(F.col("t"), F.col("b"), tax.SLAB_RATES)).first()[0] == 5.0


def test_return_category(spark):
    data = [
        ("27AABCM0001A1Z5", "Sales", "", "27", None, 1.0, "B2B"),
        ("27AABCM0001A1Z5", "Credit Note", "", "27", None, 1.0, "CDNR"),
        (None, "Sales", "", "OUTSIDE INDIA", None, 1.0, "EXP"),
        (None, "Sales", "", "Paris (FR)", None, 1.0, "EXP"),
        (None, "Sales", "", "Pune (MH)", None, 1.0, "B2CS"),
        (None, "Debit Note", "", "27", None, 1.0, "CDNUR"),
        (None, "Sales", "", "29-Karnataka", None, 250000.01, "B2CL"),
        (None, "Sales", "", "29-Karnataka", None, 250000.0, "B2CS"),
        (None, "Sales", "", "Haryana", None, 900000.0, "B2CS"),
        ("27AABCM0001A1Z5", "Sales", "", "OUTSIDE INDIA", None, 1.0, "B2B"),
    ]
    df = spark.createDataFrame(data, "g string, v string, p string, pos string, c string, t double, want string")
    got = df.select(tax.return_category(*[F.col(c) for c in "g v p pos c t".split()]), "want").collect()
    assert all(a == b for a, b in got), got


def test_itc(spark):
    data = [("8703.10", "car", "YES", "ITC_BLOCKED"), ("9971", "Health Insurance plan", "YES", "ITC_BLOCKED"), ("9971", "x", "partial", "ITC_RESTRICTED"),
            ("", None, "Allowed", "ITC_ELIGIBLE"), ("9971", "x", "maybe", "ITC_UNKNOWN"), ("9971", "x", "NIL_RATED", "ITC_EXEMPT"), (None, None, None, "ITC_UNKNOWN")]
    df = spark.createDataFrame(data, "h string, p string, g string, want string")
    assert all(a == b for a, b in df.select(itc.itc_category(F.col("h"), F.col("p"), F.col("g")), "want").collect())


def test_msme(spark):
    df = spark.createDataFrame([
        ("2024-01-01", "2024-03-01", "MICRO", True, D("100000.00")), ("2024-01-01", "2024-01-10", "micro", False, D("100000.00")),
        ("2024-01-01", None, "MEDIUM", False, D("5.00"))], "i string, p string, e string, a boolean, m decimal(18,2)")
    out = df.select(tax.msme_43bh(F.to_date("i"), F.to_date("p"), F.col("e"), F.col("a"), F.col("m"), F.lit("2024-06-01").cast("date")).alias("o")).select("o.*").collect()
    assert (out[0].days_elapsed, out[0].delay_days, out[0].disallowed_amount) == (60, 15, D("100000.00"))
    assert abs(out[0].interest_penalty - round(100000 * (1 + 0.2025 / 12) ** (60 / 30.417) - 100000, 2)) < 0.011
    assert (out[1].is_delayed, out[1].interest_penalty) == (False, 0.0)
    assert (out[2].is_unpaid, out[2].is_delayed, out[2].disallowed_amount) == (True, True, D("0.00"))


def test_tax_paths_prefer_the_earlier_of_equals(spark):
    df = spark.createDataFrame([(D("100"), D("9"), D("9"), D("0"), D("118")), (D("100"), D("0"), D("0"), D("0"), D("100")), (D("100"), D("0"), D("0"), D("18"), D("130"))],
                               "t decimal(18,2), c decimal(18,2), s decimal(18,2), i decimal(18,2), g decimal(18,2)")
    got = df.select(tax.tax_paths(*[F.col(c) for c in "tcsig"]).alias("p")).select("p.path", "p.verified").collect()
    assert [tuple(r) for r in got] == [("Path A", True), ("Path A", True), ("Path B", False)]


def test_priority(spark):
    df = spark.createDataFrame([(None, "BLOCKED", "FAILED", True, 9, 100000.0), (1.0, "ERP_READY", "PASSED", False, 0, 5.0)],
                               "c double, r string, v string, d boolean, n int, t double")
    got = [r[0] for r in df.select(score.priority_score(*[F.col(x) for x in "crvdnt"])).collect()]
    assert got == [20 + 35 + 20 + 25 + 24 + 15, 0.0]


def test_texts(spark):
    x = F.col("x")
    assert values(spark, texts.sanitize_text(x, 5), [("a\x00b  c\td e",), (None,)]) == ["ab c ...", ""]
    assert values(spark, texts.sanitize_amount(x), [("₹ 1,234.50",), ("12a",), ("-.5",), (None,)]) == ["1234.50", "", "-.5", ""]
    got = values(spark, texts.header_label(x), [("HSN/SAC",), ("Tax Amount",), ("UTGST",), ("Amount",), ("zzz",), ("CGST Amount",)])
    assert got == ["HSN", "TOTAL", "SGST", "TAXABLE", "OTHER", "CGST"]
    assert values(spark, texts.export_marker(x), [("under LUT",), ("solution",), ("Zero rated supply",)]) == [True, False, True]
    assert values(spark, dates.first_date_in(x), [("on 5/1/24 paid",), ("2024-01-05",), ("05 Jan 2024",), ("none",)]) == ["5/1/24", "2024-01-05", "05 Jan 2024", None]


def test_layout_fingerprint_ignores_order_and_case(spark):
    df = spark.createDataFrame([(["B ", "a"], [2.0, 1.0]), (["A", "b"], [1.0, 2.001])], "h array<string>, c array<double>")
    assert len({r[0] for r in df.select(texts.layout_fingerprint(F.col("h"), F.col("c"))).collect()}) == 1


def test_grading_rule(spark):
    df = spark.createDataFrame([(None, None, False, True), ("1", None, False, False), ("100.005", "100", True, True), ("x", "1", True, False), (" Ab", "aB ", False, True)],
                               "a string, b string, n boolean, want boolean")
    got = rows(df, score.values_match(F.col("a"), F.col("b"), F.col("n"), 0.01).alias("g"), "want")
    assert all(a == b for a, b in got)
