"""CSV folders: record boundaries over byte blocks, headers by name, what is refused, encodings."""

import csv
import io
import random

import pytest

from siftwell.sources import csv_folder, encodings, uploads


@pytest.fixture
def split(spark):
    """Files are cut into very small blocks."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "297b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def written(folder, files):
    folder.mkdir()
    for name, raw in files.items():
        (folder / name).write_bytes(raw.encode() if isinstance(raw, str) else raw)
    return f"file://{folder}"


def read(spark, tmp_path, files, columns=None, **options):
    found = csv_folder.read(spark, written(tmp_path / "in", files), f"file://{tmp_path}/work", columns, **options)
    rows = [(r["file"].rsplit("/", 1)[-1], r["row"], *[r[c] for c in found.columns]) for r in found.rows.orderBy("row_index").collect()]
    assert [r[0] for r in found.rows.select("row_index").orderBy("row_index").collect()] == list(range(len(rows))) or found.errors.count()
    errors = sorted((r["file"].rsplit("/", 1)[-1], r["row"] or 0, r["error"]) for r in found.errors.collect())
    return rows, errors, found


def test_random_records_over_many_blocks(split, tmp_path):
    """Quotes, commas and line breaks in fields, stray quotes in plain ones, all ends of lines: as a reader of one stream has them."""
    r, files, want = random.Random(3), {}, []
    pieces = ["a", "bb", ",", "\n", '"', "\r\n", " ", "é", '""', "x" * 40]
    for k in range(4):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator=("\n", "\r\n")[k % 2], quoting=(csv.QUOTE_MINIMAL, csv.QUOTE_ALL)[k % 3 == 0])
        names = ["p", "q", "r"] if k % 2 else ["r", "p", "q"]
        writer.writerow(names)
        body = []
        for i in range(30):
            body.append(dict(zip("pqr", ["".join(r.choice(pieces) for _ in range(r.randint(1, 6))) for _ in range(3)])))
            writer.writerow([body[-1][n] for n in names])
            if i % 9 == 0:
                out.write(("\n", "\r\n")[k % 2])
        text = out.getvalue() + ('5" pipe,x"y,"last"' if k == 1 else "")
        if k == 1:
            body.append({"p": '5" pipe', "q": 'x"y', "r": "last"})
        files[f"f{k}.csv"] = ("﻿" if k == 2 else "") + text
        want += [(f"f{k}.csv", i + 1, b["p"], b["q"], b["r"]) for i, b in enumerate(body)]
    rows, errors, found = read(split, tmp_path, files, ["p", "q", "r"], no_value=[])
    assert rows == want and errors == []
    assert found.rows.count() == len(want)
    blocks = split.read.parquet(f"file://{tmp_path}/work/blocks")
    assert blocks.count() > 20 and blocks.where("start = 1").count() > 2  # files are cut, inside quoted fields too


def test_what_is_refused(split, tmp_path):
    files = {
        "a.csv": "x,y\n1,2\n3,4,5\n6\n7,8\n",
        "b.csv": "y,x,z\n1,2,3\n",
        "c.csv": "x\n1\n",
        "d.csv": b"%PDF-1.4\nx,y\n1,2\n",
        "e.txt": "x,y\n1,2\n",
        "f.csv": 'x,y\n1,2\n"3,4\n' + "5,6\n" * 60,
        "g.csv": 'x,y\n"1"2,3\n4,5\n',
        "h.csv": b"x,y\n1\x00,2\n",
        "i.csv": "\n\n",
        "j.csv": b"x,y\n" + b"a\xa6b\xacc" * 8 + b",1\n",
        "k.csv": "x,y\n",
        "l.csv": "",
        "m.csv": "x,x,y\n1,2,NA\n",
    }
    rows, errors, found = read(split, tmp_path, files, ["x", "y"])
    assert rows == [("a.csv", 1, "1", "2"), ("a.csv", 3, "6", None), ("a.csv", 4, "7", "8"), ("b.csv", 1, "2", "1"), ("f.csv", 1, "1", "2"), ("g.csv", 2, "4", "5"), ("m.csv", 1, "1", None)]
    assert errors == [("a.csv", 2, "CSVParseError"), ("c.csv", 0, "CSVParseError"), ("d.csv", 0, "InvalidFileTypeError"), ("e.txt", 0, "InvalidFileTypeError"), ("f.csv", 2, "CSVParseError"), ("g.csv", 1, "CSVParseError"), ("h.csv", 0, "InvalidFileTypeError"), ("i.csv", 0, "NoColumnsError"), ("j.csv", 0, "EncodingDetectionError")]
    assert {r["row_index"] for r in found.rows.collect()} <= set(range(12))


def test_all_columns_of_all_files(spark, tmp_path):
    rows, errors, found = read(spark, tmp_path, {"a.csv": "x,y\n1,2\n", "b.csv": "z,x\n3,4\n", "c.csv": "x,x\n5,6\n"})
    assert found.columns == ["x", "z", "x.1", "y"] and errors == []
    assert rows == [("a.csv", 1, "1", None, None, "2"), ("b.csv", 1, "4", "3", None, None), ("c.csv", 1, "5", None, "6", None)]


TEXTS = {
    "windows-1252": "Señor, mañana habrá corazón, el niño comió jalapeños; Straße, Größe, über Äpfel; garçon à l'hôtel, crème brûlée, où êtes-vous",
    "windows-1254": "Şişli'de yağmur yağıyor, çocuklar üşüdü; İstanbul'un güneşi ışıl ışıl, Beşiktaş'ta öğrenci ağırlığı",
    "windows-1250": "Příliš žluťoučký kůň úpěl ďábelské ódy; zażółć gęślą jaźń, łódź, święto",
    "windows-1251": "Съешь ещё этих мягких французских булок, да выпей чаю; Москва, Россия, Ёлка",
    "koi8-r": "Съешь ещё этих мягких французских булок, да выпей чаю; Москва, Россия",
    "cp850": "Señor, mañana habrá corazón, el niño comió jalapeños; Straße, Größe, über Äpfel",
}


def test_encodings(spark, tmp_path):
    files = {"u.csv": 'name,n\n"ş",2\n'}
    for encoding, text in TEXTS.items():
        raw = files[f"{encoding}.csv"] = f'name,n\n"{text}",1\n'.encode(encoding)
        assert encodings.detect(raw) == encoding and uploads.decode(raw) == (raw.decode(encoding), encoding)
    rows, errors, found = read(spark, tmp_path, files, ["name", "n"])
    assert rows == [(f"{e}.csv", 1, TEXTS[e], "1") for e in sorted(TEXTS, key=lambda e: f"{e}.csv") if e < "u"] + [("u.csv", 1, "ş", "2")] + [(f"{e}.csv", 1, TEXTS[e], "1") for e in sorted(TEXTS) if e > "u"]
    assert errors == [] and {r["file"].rsplit("/", 1)[-1][:-4]: r["encoding"] for r in found.files.collect()} == {e: e for e in TEXTS} | {"u": "utf-8"}


def test_a_text_in_no_encoding():
    assert encodings.detect(b"plain") == "windows-1252"
    with pytest.raises(uploads.EncodingDetectionError):
        uploads.decode(b"a\xa6b\xacc" * 8)
    assert uploads.decode("name\nCafé René\n".encode("latin-1")) == ("name\nCafé René\n", "windows-1252")


def test_lines_stay_in_their_task_and_records_are_cut_once(split, tmp_path):
    """The scan shuffles and sorts no lines, inspection sorts none, and no filter cuts records a second time."""
    folder = written(tmp_path / "in", {f"f{k}.csv": "p,q\n" + f'{k},"a, ""b"""\n' * 90 for k in range(3)})
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    lines = csv_folder._lines(split, folder).withColumnRenamed("line", "text")
    assert not any(x in plan(csv_folder._scanned(lines)) for x in ("Exchange", "Sort", "Window"))
    assert not any(x in plan(csv_folder.inspect(split, folder)) for x in ("SortAggregate", "Window"))
    found = csv_folder.read(split, folder, f"file://{tmp_path}/work", ["p", "q"])
    assert found.rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [(r["row_index"], r["p"], r["q"]) for r in found.rows.orderBy("row_index").collect()] == [(i, str(i // 90), 'a, "b"') for i in range(270)]


def test_odd_quotes_in_batches_of_few_lines(split, tmp_path):
    """Marks before a quoted header, quotes within plain fields that would turn commas inside out, records over many batches."""
    files = {
        "a.csv": '﻿"p, 1",q\n1,2\n',
        "b.csv": '﻿"p\n",q\n1,2\n',
        "c.csv": 'x"y,z"\n5" a,"b, c"\n"d ""e"", f",6"\n"",""\n"g"h,i\n',
        "d.csv": "p,q\n" + "".join(f'{i},"{i}\n\n,{i}"\r\n' for i in range(60)),
    }
    split.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = csv_folder.read(split, written(tmp_path / "in", files), f"file://{tmp_path}/work", no_value=[])
        assert found.columns == ["p", "p\n", "p, 1", 'x"y', "q", 'z"']
        rows = [tuple(v for v in r[3:] if v is not None) for r in found.rows.orderBy("row_index").collect()]
        assert rows == [("1", "2"), ("1", "2"), ('5" a', "b, c"), ('d "e", f', '6"'), ("", ""), *[(str(i), f"{i}\n\n,{i}") for i in range(60)]]
        assert [(r["file"].rsplit("/", 1)[-1], r["row"], r["error"]) for r in found.errors.collect()] == [("c.csv", 4, "CSVParseError")]
    finally:
        split.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
