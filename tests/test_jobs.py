"""The jobs: against brute force, over growing input, broken off, run again, and by their command lines."""

import glob
import json
import logging
import os
import subprocess
import sys

import duckdb
import pytest

from jobs import new_sequences, queries, site_dataset
from jobs.common import load_config

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
PLAIN = new_sequences.DEFAULTS | {"width": 8, "stride": 4}


def said(caplog, name):
    """The counts of the log's last line that has the name."""
    return [int(r.getMessage().split(name)[1].lstrip(": ").split(",")[0]) for r in caplog.records if name in r.getMessage()][-1]


def put(spark, folder, name, rows, schema="id long, source string, sequence string"):
    """rows as one Parquet file in the folder, which appears at once."""
    aside = f"{folder}-{name}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(aside)
    os.makedirs(folder, exist_ok=True)
    os.rename(glob.glob(f"{aside}/*.parquet")[0], f"{folder}/{name}.parquet")


def table(df):
    return sorted(map(tuple, df.collect()))


def expected(batches, width=8, stride=4):
    """(id, cleaned sequence, batch, windows) of brute force."""
    seen, out = set(), []
    for number, rows in enumerate(batches):
        own = {}
        for i, s, x in rows:
            x = "".join(c if c in "ACGTN" else "N" for c in "".join((x or "").split()).upper().replace("U", "T"))
            if i is not None and x and x not in seen and (x not in own or (i, s) < own[x]):
                own[x] = (i, s)
        seen |= own.keys()
        out += [(i, x, number, [x] if len(x) <= width else [x[o : o + width] for o in range(0, len(x) - width + 1, stride)]) for x, (i, _) in own.items()]
    return sorted((i, w, k, b) for i, x, b, found in out for k, w in enumerate(found))


def windows(df):
    return sorted((r.id, r.window, r.win_index, r.batch) for r in df.collect())


FIRST = [(1, "a", "ACGTACGTACGTAC"), (2, "a", "acg u acguacguac"), (3, "b", "TTTT"), (None, "b", "GGGG"), (4, None, None), (5, "b", " \n"), (6, "b", "TTTT")]
SECOND = [(7, "c", "TTTT"), (8, "c", "CCCCCCCCCCCC"), (8, "c", "CCCCCCCCCCCC"), (0, "c", "ACGTACGTACGTAC"), (9, "c", "GGXGG")]


def test_windows_of_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    put(spark, source, "one", FIRST)
    new_sequences.run(spark, source, out, mark, PLAIN)
    assert windows(new_sequences.read(spark, out)) == expected([FIRST])
    assert (said(caplog, "read "), said(caplog, "with id and sequence "), said(caplog, "new ")) == (7, 4, 2)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{out}/batch=0/*/*.parquet")}

    new_sequences.run(spark, source, out, mark, PLAIN)  # nothing new
    assert windows(new_sequences.read(spark, out)) == expected([FIRST])

    put(spark, source, "two", SECOND)
    os.utime(f"{source}/two.parquet", (1, 1))  # an old file that arrives late
    caplog.clear()
    new_sequences.run(spark, source, out, mark, PLAIN)
    assert windows(new_sequences.read(spark, out)) == expected([FIRST, SECOND])
    assert (said(caplog, "read "), said(caplog, "distinct in the batch "), said(caplog, "new ")) == (5, 4, 2)
    assert before == {f: os.path.getmtime(f) for f in glob.glob(f"{out}/batch=0/*/*.parquet")}

    again = str(tmp_path / "anew")  # a new checkpoint over the same table begins anew
    new_sequences.run(spark, source, out, again, PLAIN)
    assert windows(new_sequences.read(spark, out)) == expected([FIRST + SECOND])


def test_a_broken_batch_is_done_again(spark, tmp_path, monkeypatch):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    put(spark, source, "one", FIRST)
    new_sequences.run(spark, source, out, mark, PLAIN)
    put(spark, source, "two", SECOND)

    def fail(*_):  # after the batch was written, before the checkpoint says so
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(new_sequences.LOG, "info", fail)
        with pytest.raises(Exception, match="lost"):
            new_sequences.run(spark, source, out, mark, PLAIN)
    new_sequences.run(spark, source, out, mark, PLAIN)
    assert windows(new_sequences.read(spark, out)) == expected([FIRST, SECOND])


def test_files_in_several_batches_and_empty_ones(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for k, rows in enumerate(([], FIRST, SECOND)):
        put(spark, source, str(k), rows)
        os.utime(f"{source}/{k}.parquet", (1000 + k, 1000 + k))
    new_sequences.run(spark, source, out, mark, PLAIN | {"files_a_batch": 1})
    assert windows(new_sequences.read(spark, out)) == expected([[], FIRST, SECOND])


def test_splits_are_by_sequence(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, source, "one", [(i, "s", "ACGT"[i % 4] * 9 + bin(i)[2:].replace("0", "A").replace("1", "C") * 3) for i in range(400)])
    new_sequences.run(spark, source, out, str(tmp_path / "mark"), PLAIN)
    found = new_sequences.read(spark, out).select("key", "split").distinct().collect()
    assert len(found) == len({r.key for r in found}) and 15 < sum(r.split == "val" for r in found) < 75


SITES = "chrom string, pos long, strand string, source string, sequence string, chrom_2 int"
ROWS = [("chr1", 100, "+", "A", "CCAATAAACC", 0), ("chr1", 100, "+", "B", "GG", 0), ("chr1", 110, "+", "B", "TT", 0), ("chr1", 500, "-", "B", None, 0), ("chr2", 7, "+", "A", "AC", 0), (None, 1, "+", "A", "A", 0), ("chr3", None, "+", "A", "A", 0), ("chr1", 100, "+", "A", "CCAATAAACC", 0)]
GENES = [("chr1", 50, 120, "G1", 1), ("chr1", 60, 90, "G2", 2), ("chr2", 8, 20, "G3", 3), (None, 1, 2, "G4", 4)]


@pytest.fixture
def site_tables(spark, tmp_path):
    spark.createDataFrame(ROWS, SITES).repartition(3).write.parquet(f"{tmp_path}/sites")
    spark.createDataFrame(GENES, "chrom string, g_start long, g_end long, gene_id string, ord long").write.parquet(f"{tmp_path}/genes")
    return f"{tmp_path}/sites", f"{tmp_path}/genes", f"{tmp_path}/out"


def test_sites_of_two_collections(spark, site_tables, caplog):
    caplog.set_level(logging.INFO)
    config = {"leading": "source = 'A'", "held_out": ["chr2"]}
    site_dataset.run(spark, *site_tables, config)
    columns = ["chrom", "pos", "strand", "cluster_start", "n_sites", "source", "sequence", "gene_id", "hexamer", "split"]
    found = table(site_dataset.read(spark, site_tables[2]).select(*columns))
    want = [("chr1", 100, "+", 100, 2, "A,B", "CCAATAAACC", "G1", True, "train"), ("chr1", 500, "-", 500, 1, "B", None, "", False, "train"), ("chr2", 7, "+", 7, 1, "A", "AC", "", False, "val")]
    assert [tuple(map(str, r)) for r in found] == [tuple(map(str, r)) for r in sorted(want, key=str)]
    assert [said(caplog, x) for x in ("sites read", "sites with coordinates", "distinct sites", "clusters", "sites written")] == [8, 6, 4, 3, 3]
    report = spark.read.json(f"{site_tables[2]}/report").collect()
    assert {r.metric: r.value for r in report}["n_rows"] == 3
    site_dataset.run(spark, *site_tables, config)
    assert table(site_dataset.read(spark, site_tables[2]).select(*columns)) == found


def test_only_some_chromosomes_are_made_anew(spark, site_tables):
    sites, genes, out = site_tables
    site_dataset.run(spark, sites, genes, out, {})
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{out}/sites/*/*.parquet")}
    whole = table(site_dataset.read(spark, out).fillna(""))
    site_dataset.run(spark, sites, genes, out, {"chroms": ["chr2"]})
    after = {f: os.path.getmtime(f) for f in glob.glob(f"{out}/sites/*/*.parquet")}
    assert {f for f in before if "chr1" in f} <= after.keys() and not {f for f in before if "chr2" in f} & after.keys()
    assert table(site_dataset.read(spark, out).fillna("")) == whole
    spark.createDataFrame([r for r in ROWS if r[0] == "chr1"], SITES).write.parquet(f"{sites}-fewer")
    site_dataset.run(spark, f"{sites}-fewer", genes, out, {})  # a whole run leaves no folder of what is gone
    assert {r[0] for r in site_dataset.read(spark, out).select("chrom").distinct().collect()} == {"chr1"}


def test_empty_tables(spark, site_tables):
    sites, genes, out = site_tables
    for k, (a, b) in enumerate(((True, False), (False, True), (True, True))):
        paths = []
        for empty, path in ((a, sites), (b, genes)):
            spark.read.parquet(path).limit(0 if empty else 1000).write.parquet(f"{path}-{k}")
            paths.append(f"{path}-{k}")
        site_dataset.run(spark, *paths, f"{out}-{k}", {})
        assert site_dataset.read(spark, f"{out}-{k}").count() == (0 if a else 3)


def test_configs(tmp_path):
    for job in (site_dataset, new_sequences):
        assert queries.config(job).keys() == job.DEFAULTS.keys()
    (tmp_path / "c.json").write_text('{"widht": 3}')
    with pytest.raises(ValueError, match="widht"):
        load_config(str(tmp_path / "c.json"), new_sequences.DEFAULTS)


def test_command_lines(spark, site_tables, tmp_path):
    sites, genes, out = site_tables
    put(spark, str(tmp_path / "in"), "one", FIRST)
    (tmp_path / "sites.json").write_text(json.dumps({"leading": "source = 'A'"}))
    (tmp_path / "new.json").write_text(json.dumps({"width": 8, "stride": 4}))
    env = os.environ | {"PYTHONPATH": "", "SPARK_CONF_DIR": str(tmp_path)}
    runs = [["site_dataset.py", "--config", f"{tmp_path}/sites.json", "--sites", sites, "--genes", genes, "--out", out], ["new_sequences.py", "--config", f"{tmp_path}/new.json", "--input", f"{tmp_path}/in", "--out", f"{tmp_path}/windows", "--checkpoint", f"{tmp_path}/mark"]]
    for command in runs:
        done = subprocess.run([sys.executable, os.path.join(ROOT, "jobs", command[0]), *command[1:]], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
        assert done.returncode == 0, done.stderr[-3000:]
        assert "written" in done.stderr
    assert site_dataset.read(spark, out).count() == 3
    assert windows(new_sequences.read(spark, f"{tmp_path}/windows")) == expected([FIRST])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_registered_jobs_equal_their_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    df = queries.QUERIES[name](spark, DATA)
    columns = ", ".join(f'"{x}"' for x in df.columns)
    say = lambda rows: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)
    assert say(df.collect()) == say(c.sql(f"select {columns} from ({queries.ORACLE[name]})").fetchall())
