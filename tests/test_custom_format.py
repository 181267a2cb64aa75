"""Records that span lines, read in byte ranges that fall anywhere."""

import re

import pytest

from huntlake.sources.custom import TASKS, records, scan_custom

START = re.compile(rb"^#\d+")


def write(tmp_path, name, text):
    (tmp_path / name).write_bytes(text)
    return str(tmp_path / name)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16, 1000])
def test_every_record_once_for_any_cut(tmp_path, size):
    blocks = [b"#%d one\n" % i + b"".join(b"  line %d of %d\r\n" % (j, i) for j in range(i % 4)) for i in range(30)]
    text = b"lost before the first\n" + b"".join(blocks) + b"#99 without an end"
    path = write(tmp_path, "a", text)
    got = [r for at in range(0, len(text), size) for r in records(path, at, min(at + size, len(text)), START)]
    assert b"".join(data for _, data in got) == text[len(b"lost before the first\n"):]
    assert all(text[at:at + len(data)] == data and START.match(data) for at, data in got) and len(got) == 31


def test_scan(spark, tmp_path):
    write(tmp_path, "b.txt", "#1 ann\n  says: hé\n  again\n#2\n#3 bob\n".encode())
    write(tmp_path, "_hidden", b"#9 no\n")
    write(tmp_path, "empty", b"")
    df = scan_custom(spark, str(tmp_path), r"^#\d+", r"#(?P<id>\d+) (?P<who>\w+)(?:\n  says: (?P<said>.*))?", rangeBytes="5")
    assert df.columns == ["id", "who", "said", "raw", "file", "offset"]
    rows = {r.offset: (r.id, r.who, r.said, r.raw) for r in df.collect()}
    assert rows == {0: ("1", "ann", "hé\n  again", None), 27: (None, None, None, "#2"), 30: ("3", "bob", None, None)}
    assert df.rdd.getNumPartitions() >= 5
    with pytest.raises(Exception, match="nowhere"):
        scan_custom(spark, str(tmp_path) + "/nowhere", "^#", "(?P<a>.*)").collect()


def test_many_small_ranges_share_partitions(spark, tmp_path):
    for f in ("a", "b"):
        write(tmp_path, f, b"".join(b"#%d x\n and\n" % i for i in range(1500)))
    df = scan_custom(spark, str(tmp_path), r"^#\d+", r"#(?P<id>\d+) x\n and", rangeBytes="5")
    assert df.rdd.getNumPartitions() <= TASKS
    assert sorted(int(r.id) for r in df.collect()) == sorted([*range(1500)] * 2)
