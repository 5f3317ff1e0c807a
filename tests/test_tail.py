"""Files that grow: every line once, in order, whatever the parts; a restart in the middle of a file."""

import io

import pyarrow as pa

from plantlens.streaming.ledger import Ledger
from plantlens.streaming.stream import ingest_all
from plantlens.streaming.tail import TailReader, lines_of
from tests.test_classifier import categories, model, stream


def test_parts_hold_every_line_once(tmp_path, monkeypatch):
    from plantlens.streaming import tail

    data = b"one\n\ntwo\r\nthree and more\n\xff\xfe\nlast\n" + b"x" * 40 + b"\n" + b"not ended"
    (tmp_path / "a.txt").write_bytes(data)
    (tmp_path / ".hidden").write_bytes(b"no\n")
    want, at = [], 0
    for row in data.split(b"\n")[:-1]:
        want.append((at, row.removesuffix(b"\r")))
        at += len(row) + 1
    for piece in (1, 3, 1000):
        monkeypatch.setattr(tail, "PIECE", piece)
        for part in (1, 2, 5, 7, 1000):
            reader = TailReader(str(tmp_path), part)
            end = reader.latestOffset()
            assert end == {str(tmp_path / "a.txt"): len(data) - 9} and reader.latestOffset() == end
            found = [row for p in reader.partitions({}, end) for row in lines_of(pa.PythonFile(io.BytesIO(data), "r"), p.begin, p.end, p.first)]
            assert found == want
            half = {str(tmp_path / "a.txt"): 10}
            assert [r for p in reader.partitions(half, end) for r in lines_of(pa.PythonFile(io.BytesIO(data), "r"), p.begin, p.end, p.first)] == [r for r in want if r[0] >= 10]


def test_growing_files_give_the_same_ledger(spark, tmp_path):
    raws = stream(23, 90)
    drop, args = tmp_path / "drop", (str(tmp_path / "drop"), str(tmp_path / "ledger"), str(tmp_path / "check"))
    drop.mkdir()
    lines = [f"{i}\t{r}\n" for i, r in enumerate(raws)]
    (drop / "a.txt").write_text("".join(lines[:30]) + lines[30][:7])
    assert sum(ingest_all(spark, *args, growing=True).values()) == 30
    with (drop / "a.txt").open("a") as f:  # the cut line ends, and more come
        f.write(lines[30][7:] + "".join(lines[31:50]))
    (drop / "b.txt").write_text("".join(lines[50:]))
    assert sum(ingest_all(spark, *args, growing=True).values()) == 90
    assert sum(ingest_all(spark, *args, growing=True).values()) == 90
    rows = Ledger(spark, args[1]).read()
    assert categories(rows) == model(raws)
    assert [r.block for r in rows.where("file like '%a.txt'").orderBy("arrival_id").collect()] == [len("".join(lines[:k]).encode()) for k in range(50)]
