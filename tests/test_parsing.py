import pytest
from pyspark.sql import functions as F

from breakfold.functions import parsing, tags
from breakfold.sources import vcf


def line(chrom="1", pos=100, ref="N", alt="<DEL>", info="END=200", rest=()):
    return "\t".join([chrom, str(pos), "id", ref, alt, ".", "PASS", info, *rest])


@pytest.fixture(scope="module")
def parse(spark):
    def run(*lines):
        df = spark.createDataFrame([(n, x) for n, x in enumerate(lines)], "n int, line string")
        return {r.n: (r.chrA, r.posA, r.chrB, r.posB, r.event_type) for r in parsing.parse_calls(df).collect()}

    return run


CASES = [
    (line(), ("1", 100, "1", 200, "DEL")),
    (line("chr1"), ("1", 100, "1", 200, "DEL")),
    (line(info="SVLEN=-50"), ("1", 100, "1", 150, "DEL")),
    (line(info="X"), ("1", 100, "1", 100, "DEL")),
    (line(info="END=40"), ("1", 40, "1", 100, "DEL")),
    (line(alt="<DUP:TANDEM>"), ("1", 100, "1", 200, "DUP")),
    (line(alt="<INS:ME:ALU>"), ("1", 100, "1", 100, "INS:ME:ALU")),
    (line(alt="<DEL>", info="SVTYPE=CNV;END=200"), ("1", 100, "1", 200, "DEL")),
    (line(alt=".", info="SVTYPE=INV;END=200"), ("1", 100, "1", 200, "INV")),
    (line(ref="A", alt="ACGT", info="Z=1"), ("1", 100, "1", 100, "INS")),
    (line(ref="ACGTA", alt="A", info="Z=1"), ("1", 100, "1", 104, "DEL")),
    (line(alt="*", info="END=120"), ("1", 100, "1", 120, "")),
    (line("18", 10, alt="[2:5000[N", info="SVTYPE=BND"), ("18", 10, "2", 5000, "BND")),
    (line("2", 10, alt="[[18:5000[[N", info="SVTYPE=BND"), ("18", 5000, "2", 10, "BND")),
    (line("1", 900, alt="]1:100]N", info="SVTYPE=BND"), ("1", 100, "1", 900, "BND")),
    (line("1", 9, alt="N]HLA:01:77]", info="SVTYPE=BND"), ("1", 9, "HLA:01", 77, "BND")),
    (line("3", 10, alt="<TRA>", info="CHR2=X;END=70"), ("3", 10, "X", 70, "BND")),
    (line("X", 10, alt="<TRA>", info="CHR2=3;END=70"), ("3", 10, "X", 10, "BND")),
]


def test_calls(parse):
    got = parse(*[c for c, _ in CASES])
    for n, (text, want) in enumerate(CASES):
        assert got[n] == want, text


def test_headers_blanks_and_bad_numbers(spark):
    df = spark.createDataFrame([("##x",), ("#CHROM\tPOS",), ("",), ("  ",), (line(),), (line(pos="x"),)], "line string")
    out = parsing.parse_calls(df)
    assert out.count() == 2
    assert parsing.rejected(out).count() == 1


def test_info_ci_format(spark):
    df = spark.createDataFrame([("A=1;FLAG;B=x=y;A=2;C=", "CIPOS=(-10,20);CIEND=7", "GT:DP:CN", ["0/1:3", "1/1"])], "i string, c string, f string, s array<string>")
    r = df.select(parsing.info_map(F.col("i")).alias("m"), parsing.info_value(F.col("i"), "A").alias("a"), *parsing.ci_columns(F.col("c")), parsing.format_map(F.col("f"), F.col("s")).alias("f")).first()
    assert r.m == {"A": "2", "B": "x=y", "C": ""}
    assert r.a == "2"
    assert (r.ci_A_lower, r.ci_A_upper, r.ci_B_lower, r.ci_B_upper) == (10, 20, 7, 7)
    assert r.f == {"GT": ["0/1", "1/1"], "DP": ["3", "."], "CN": [".", "."]}


def test_chrom_names(spark):
    df = spark.createDataFrame([("chr1",), ("CHRX",), ("ChrchrY",), ("chR2",)], "c string")
    assert [r[0] for r in df.select(parsing.normalize_chrom(F.col("c"))).collect()] == ["1", "X", "Y", "chR2"]


def test_tags(spark):
    df = spark.createDataFrame([("a;b:c|d", "K=1,2;F;S=x:y;T=p|q", "GT:DP", ["0/1:3,4", "1"], ["s1", "s2"], "1\t2\tK=0;SVTYPE=DEL;END=5")], "v string, i string, f string, s array<string>, n array<string>, l string")
    r = df.select(
        tags.sanitize_id(F.col("v")).alias("v"), tags.collect_info(F.col("v"), F.col("i")).alias("i"), tags.collect_sample(F.col("v"), F.col("f"), F.col("s"), F.col("n")).alias("s"),
        parsing.retrieve_key(F.col("l"), "SVTYPE").alias("k"), parsing.retrieve_key(F.col("l"), "NO").alias("none"), parsing.retrieve_key(F.col("l"), "K").alias("tab"),
    ).first()
    assert r.v == "a_b_c_d"
    assert r.i == "a_b_c_d|K:1:2|F"
    assert r.s == "a_b_c_d|s1|GT:0/1|DP:3:4|s2|GT:1|DP:."
    assert (r.k, r.none, r.tab) == ("DEL", None, "0")


@pytest.mark.parametrize(
    ("present", "passing", "want"),
    [(["a", "b"], ["a", "b"], "Intersection"), (["a", "b"], [], "FilteredInAll"), (["a"], [], "filterIna"), (["a", "b"], ["b"], "filterIna-b"), (["b"], ["b"], "b")],
)
def test_set_tag(spark, present, passing, want):
    df = spark.createDataFrame([(present, passing)], "p array<string>, q array<string>")
    r = df.select(tags.set_tag(["a", "b"], F.col("p"), F.col("q")), tags.supp_vec(["b", "a"], F.col("p"))).first()
    assert r[0] == want
    assert r[1] == "".join("01"[s in present] for s in ("a", "b"))


def test_csq(spark):
    df = spark.createDataFrame([("A=1;CSQ=x,y;B=2", ["z", "x"]), ("A=1", ["z"])], "i string, e array<string>")
    assert [r[0] for r in df.select(tags.merge_csq(F.col("i"), F.col("e"))).collect()] == ["A=1;CSQ=x,y,z;B=2", "A=1"]


def test_bedpe(spark):
    df = spark.createDataFrame([(0, "1 500 1 100  DEL 3 0.5"), (1, "X\t5\t2\t9\tBND\t1\t0.1"), (2, "# c")], "db_ord int, line string")
    assert [tuple(r) for r in vcf.parse_bedpe(df).orderBy("db_ord").collect()] == [("1", 100, "1", 500, "DEL", 3, 0.5, 0), ("2", 9, "X", 5, "BND", 1, 0.1, 1)]
