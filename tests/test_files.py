import gzip

import pytest

from breakfold import cli
from breakfold.operators import store
from breakfold.sources import vcf
from breakfold.streaming.append import append_arriving

HEAD = ["##fileformat=VCFv4.1", "##contig=<ID=2,length=5>", "##contig=<ID=1,length=5>", '##INFO=<ID=END,Number=1,Type=Integer,Description="e">']


def write(path, rows, samples=("S",)):
    text = "\n".join([*HEAD, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])] + ["\t".join(r) for r in rows]) + "\n"
    if str(path).endswith(".gz"):
        with gzip.open(path, "wt") as f:
            f.write(text)
    else:
        path.write_text(text)
    return str(path)


def row(chrom, pos, end, vid="v", kind="DEL", gts=("0/1",), filt="PASS"):
    return [chrom, str(pos), vid, "N", f"<{kind}>", ".", filt, f"SVTYPE={kind};END={end}", "GT", *gts]


@pytest.fixture
def two(tmp_path):
    a = write(tmp_path / "a.vcf", [row("chr1", 100, 900), row("chr1", 5000, 9000, filt="q"), row("2", 10, 700)], ("A",))
    b = write(tmp_path / "b.vcf.gz", [row("1", 101, 901), row("1", 5000, 9000, gts=("0/0",))], ("B",))
    return a, b


def body(path):
    import glob

    return [x for part in sorted(glob.glob(f"{path}/body/part-*.txt")) for x in open(part).read().splitlines()]


def test_build_query_export(spark, two, tmp_path):
    db = str(tmp_path / "db")
    assert cli.main(["build", "--files", two[0], str(tmp_path / "none.vcf"), "--prefix", db], spark) == 0
    assert cli.main(["build", "--files", two[1], "--prefix", db], spark) == 0
    held = store.scan(spark, db)
    assert sorted((r.sample, r.idx) for r in held.collect()) == [("A", 0), ("A", 1), ("A", 2), ("B", 3)]
    out = str(tmp_path / "q")
    assert cli.main(["query", "--query_vcf", two[0], "--table", db, "--prefix", out], spark) == 0
    got = body(out)
    assert [x.split("\t")[7] for x in got] == ["SVTYPE=DEL;END=900;OCC=2;FRQ=1.0", "SVTYPE=DEL;END=9000;OCC=1;FRQ=0.5", "SVTYPE=DEL;END=700;OCC=1;FRQ=0.5"]
    out = str(tmp_path / "e")
    assert cli.main(["export", "--db", db, "--prefix", out], spark) == 0
    got = body(out)
    assert len(got) == 3
    assert got[0].split("\t")[9:] == ["./1", "./1"]
    cli.main(["export", "--db", db, "--no_merge", "--prefix", out], spark)
    assert len(body(out)) == 4


def test_query_call_set(spark, two, tmp_path):
    out = str(tmp_path / "q")
    assert cli.main(["query", "--query_vcf", two[0], "--db", two[1], "--prefix", out], spark) == 0
    assert [x.split("\t")[7].split(";OCC")[-1] for x in body(out)] == ["=1;FRQ=1.0", "SVTYPE=DEL;END=9000", "SVTYPE=DEL;END=700"]
    assert cli.main(["query", "--query_vcf", two[0]], spark) == 0
    assert cli.main(["query", "--query_vcf", two[0], "--db", two[1], "--table", "x"], spark) == 1


def test_merge(spark, two, tmp_path):
    out = str(tmp_path / "m")
    assert cli.main(["merge", "--vcf", *two, "--prefix", out], spark) == 0
    got = [x.split("\t") for x in body(out)]
    assert [(x[0], x[1]) for x in got] == [("2", "10"), ("chr1", "100"), ("chr1", "5000")]
    first = got[1]
    assert first[2] == "v:a|v:b"
    assert "VARID=v:b;set=Intersection;FOUNDBY=2" in first[7] and first[7].endswith(";SUPP_VEC=11")
    assert first[8:] == ["GT", "0/1", "0/1"]
    assert got[2][9:] == ["0/1", "0/0"] and "set=filterIna-b" in got[2][7]
    assert got[0][9:] == ["0/1", "./."]
    assert cli.main(["merge", "--vcf", two[0] + ":x", two[1] + ":y", "--priority", "x,z", "--prefix", out], spark) == 1
    # merging a set with itself gives each call once
    assert cli.main(["merge", "--vcf", two[0] + ":x", two[0] + ":y", "--priority", "x,y", "--prefix", out, "--notag"], spark) == 0
    assert len(body(out)) == 3 and "set=" not in body(out)[0]


def test_headers():
    h = vcf.query_header(HEAD + ["#CHROM"])
    assert [x.split(",")[0] for x in h[4:6]] == ["##INFO=<ID=OCC", "##INFO=<ID=FRQ"]
    assert vcf.query_header(h) == h
    m = vcf.Headers({"a": [*HEAD, "##source=x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\tT"], "b": ["##contig=<ID=9>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tT\tU"]})
    assert m.samples == ["S", "T", "U"] and list(m.contigs) == ["2", "1"] and m.order["T"] == {"a": 1, "b": 0}
    assert not any("##source=x" in x for x in m.merged(["a", "b"]))


def test_folder_and_names(spark, two, tmp_path):
    assert [p.rsplit("/", 1)[1] for p in vcf.folder_files(spark, str(tmp_path))] == ["a.vcf", "b.vcf.gz"]
    assert vcf.file_sample("/x/y.vcf.gz") == "y_vcf" and vcf.source_tag("/x/y.z.vcf.gz") == "y.z"
    assert store.tables(spark, str(tmp_path / "no")) == []
    with pytest.raises(FileNotFoundError):
        vcf.read_calls(spark, ["/none.vcf"])


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/a.vcf", [row("1", 100, 900)], ("A",))
    db = str(tmp_path / "db")
    append_arriving(spark, str(tmp_path / "in"), db, str(tmp_path / "cp")).awaitTermination()
    write(tmp_path / "in/b.vcf", [row("1", 150, 950)], ("B",))
    append_arriving(spark, str(tmp_path / "in"), db, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.sample, r.posA, r.idx) for r in store.scan(spark, db).collect()) == [("A", 100, 0), ("B", 150, 1)]
