"""MIDI: the notes of Standard MIDI Files, read as binary files by Spark and parsed on the executors."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

# Names of the twelve notes, and frequencies of the notes of octave 5.
NOTES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
FREQUENCIES = {"C": 523.25, "C#": 554.36, "D": 587.33, "D#": 622.25, "E": 659.25, "F": 698.46, "F#": 739.99, "G": 783.99, "G#": 830.61, "A": 440.00, "A#": 466.16, "B": 493.88}
SCHEMA = "time double, note string, octave int, freq double, length double, amplitude double, track int"


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length number and the place after it."""
    value = 0
    while True:
        byte = data[at]
        at += 1
        value = value << 7 | byte & 0x7F
        if byte < 0x80:
            return value, at


def _events(track: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tick, status, data) of note, tempo and other events; status 0x51 stands for a tempo change."""
    at = tick = status = 0
    while at < len(track):
        delta, at = _number(track, at)
        tick += delta
        if track[at] & 0x80:
            status = track[at]
            at += 1
        if status == 0xFF:
            kind = track[at]
            size, at = _number(track, at + 1)
            if kind == 0x51:
                yield tick, 0x51, track[at : at + size]
            at += size
        elif status in (0xF0, 0xF7):
            size, at = _number(track, at)
            at += size
        else:
            size = 1 if status & 0xF0 in (0xC0, 0xD0) else 2
            yield tick, status & 0xF0, track[at : at + size]
            at += size


def notes(data: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA, as notes end. A tempo change holds for all that follows, in later tracks as well."""
    if data[:4] != b"MThd":
        raise ValueError("not a Standard MIDI File")
    size, _, tracks, beat = struct.unpack(">IHHH", data[4:14])
    at, tempo = 8 + size, 0
    for number in range(tracks):
        size = struct.unpack(">I", data[at + 4 : at + 8])[0]
        track, at = data[at + 8 : at + 8 + size], at + 8 + size
        sounding: dict[int, tuple[int, int]] = {}
        for tick, kind, body in _events(track):
            if kind == 0x51:
                tempo = int.from_bytes(body, "big")
            elif kind == 0x90:
                sounding[body[0]] = (tick, min(body[1], 127))
            elif kind == 0x80 and body[0] in sounding:
                start, velocity = sounding.pop(body[0])
                second = tempo / 1e6 / beat
                octave, place = divmod(body[0], 12)
                name = NOTES[place]
                yield start * second, name, octave, FREQUENCIES[name] * 2.0 ** (octave - 5), tick * second - start * second, velocity / 128.0, number


def _parse(batches):
    import pandas as pd

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for frame in batches:
        for content in frame["content"]:
            rows = list(notes(bytes(content)))
            if rows:
                yield pd.DataFrame(rows, columns=names)


def read_midi(spark: SparkSession, path: str) -> DataFrame:
    """Any number of files (a file, folder or pattern), each parsed by one task."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select(F.col("content")).mapInPandas(_parse, SCHEMA)
