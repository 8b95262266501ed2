"""Addresses of files by ranges equal those of whole contents."""

import hashlib
import random

import pytest

from veinstone.functions import address
from veinstone.sources import files

SIZES = [0, 1, 1023, 1024, 1025, 2048, 2049, 4096, 6145, 8192, 10_000, 16_384, 16_385, 33_000, 70_001]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    place = tmp_path_factory.mktemp("files")
    rng = random.Random(41)
    for n in SIZES:
        (place / f"f{n}").write_bytes(rng.randbytes(n))
    (place / "below").mkdir()
    (place / "below" / "é x").write_bytes(b"abc")
    return place


def contents(folder):
    return {str(p): p.read_bytes() for p in folder.rglob("*") if p.is_file()}


@pytest.mark.parametrize("piece, fan", [(1024, 2), (2048, 4), (4096, 2), (files.PIECE, files.FAN)])
def test_blake3_of_files_by_pieces(spark, folder, piece, fan):
    known = contents(folder)
    sized = files.sized(spark.createDataFrame([(p,) for p in [*known, *known, f"{folder}/absent", str(folder), None]], "path string"))
    got = {r["path"]: r["cid"] for r in files.addresses(sized, "blake3", piece=piece, fan=fan).collect()}
    assert got == {p: address.blake3(data) for p, data in known.items()}


def test_sha256_of_files_is_streamed(spark, folder, monkeypatch):
    monkeypatch.setattr(files, "READ", 1000)
    known = {p: c for p, c in contents(folder).items() if c}
    listed = files.listing(spark, str(folder))
    assert {r["length"] for r in listed.collect()} == {len(c) for c in known.values()}
    got = sorted(r["cid"] for r in files.addresses(listed).collect())
    assert got == sorted(hashlib.sha256(c).hexdigest() for c in known.values())
    empty = files.addresses(files.sized(spark.createDataFrame([(f"{folder}/f0",)], "path string")))
    assert empty.first()["cid"] == hashlib.sha256(b"").hexdigest()


def test_values_of_pieces_join_to_the_digest_of_the_whole():
    rng = random.Random(43)
    for n in (3000, 4096, 5000, 9000, 12_289):
        data = rng.randbytes(n)
        pieces = [data[i : i + 2048] for i in range(0, n, 2048)]
        values = address.blake3_values(pieces, [2 * i for i in range(len(pieces))], [False] * len(pieces))
        assert address.blake3_joined([values], [True])[0].hex() == address.blake3(data)


def test_files_that_change_or_are_none(spark, folder):
    none = spark.createDataFrame([], "path string, length long")
    assert files.addresses(none, "blake3").collect() == [] and files.addresses(none).collect() == []
    with pytest.raises(ValueError, match="power"):
        files.addresses(none, "blake3", piece=3000)
    longer = spark.createDataFrame([(f"{folder}/f1024", 5000)], "path string, length long")
    with pytest.raises(Exception, match="changed"):
        files.addresses(longer, "blake3", piece=1024).collect()
