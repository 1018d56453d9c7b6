"""Audio features of 8-bit samples: polyphase resampling, log-mel filterbanks, energy segments, fixed-shape tensors.

Media are RIFF/WAVE files of one channel of unsigned 8-bit samples, so bytes are stored as they are and read back from
the file. Features are computed per file, in an order of operations that depends on that file alone: equal files give
equal values, whatever shares their batch. A file is held whole, as floats and as resampled ones; only its spectra are
made in stretches of frames.
"""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists, raw, refuse, slices, table, texts

_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
BLOCK = 64


@dataclass(frozen=True)
class Settings:
    """Sampling rate of the media, rate after resampling, frames (samples at that rate), bands, and tensor shape."""

    rate: int = 16_000
    target: int = 8_000
    taps: int = 16  # of each phase of the resampling filter, on either side
    frame: int = 400
    hop: int = 160
    bands: int = 32
    frames: int = 16  # of one tensor: its shape is (frames, bands)
    on: float = -6.0  # decibels below the loudest frame at which a segment begins
    off: float = -12.0  # and below which it ends


def wave(samples: bytes, rate: int = Settings.rate) -> bytes:
    """A WAVE file of one channel of 8-bit samples."""
    n = len(samples)
    return _HEADER.pack(b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + samples + b"\0" * (n % 2)


def samples(media: bytes) -> tuple[bytes, int]:
    """The samples of a WAVE file as :func:`wave` writes it, and their rate; other chunks are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate = struct.unpack_from("<HHI", media, at + 8)
            if (kind, channels, struct.unpack_from("<H", media, at + 22)[0]) != (1, 1, 8):
                raise ValueError("not 8-bit samples of one channel")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@functools.lru_cache(maxsize=4)
def _filters(s: Settings):
    """Resampling phases, frame window, and mel filterbank."""
    g = np.gcd(s.rate, s.target)
    up, down = s.target // g, s.rate // g
    half = s.taps * max(up, down)
    k = np.arange(-half, half + 1)
    h = np.sinc(k / max(up, down)) / max(up, down) * np.kaiser(len(k), 8.0) * up
    width = -(-len(h) // up)
    phases = [np.pad(h[p::up], (0, width - len(h[p::up])))[::-1].astype(np.float32).copy() for p in range(up)]
    size = 1 << (s.frame - 1).bit_length()
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40.0), mel(s.target / 2), s.bands + 2) / 2595) - 1)
    f = np.arange(size // 2 + 1) * s.target / size
    rise, fall = (f[:, None] - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f[:, None]) / np.diff(edges)[1:]
    bank = np.maximum(0, np.minimum(rise, fall)).astype(np.float32)
    return up, down, half, phases, np.hanning(s.frame).astype(np.float32), size, bank


def resample(x: np.ndarray, s: Settings) -> np.ndarray:
    """Rational resampling: each output sample takes one phase of the filter, so only wanted samples are computed."""
    up, down, half, phases, *_ = _filters(s)
    n = -(-len(x) * up // down)
    width = len(phases[0])
    padded = np.pad(x, (width, width + down))
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):  # outputs first, first + up, ... share a phase
        shift, phase = divmod(first * down + half, up)
        many = len(range(first, n, up))
        seen = np.lib.stride_tricks.sliding_window_view(padded, width)
        start = shift - width + 1 + width
        rows = seen[np.minimum(start + down * np.arange(many), len(seen) - 1)] if up > 1 or start + down * (many - 1) >= len(seen) else seen[start : start + down * (many - 1) + 1 : down]
        out[first::up] = rows @ phases[phase]
    return out


def log_mel(y: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames, bands) of overlapping frames, and each frame's energy in decibels."""
    *_, window, size, bank = _filters(s)
    n = max(1, -(-(len(y) - s.frame) // s.hop) + 1)
    y = np.pad(y, (0, max(0, (n - 1) * s.hop + s.frame - len(y))))
    frames = np.lib.stride_tricks.sliding_window_view(y, s.frame)[:: s.hop][:n]
    mels, energy = np.empty((n, s.bands), np.float32), np.empty(n, np.float32)
    for lo in range(0, n, 4096):
        part = frames[lo : lo + 4096]
        spectrum = np.fft.rfft(part * window, size)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels[lo : lo + 4096] = np.log(power @ bank + 1e-6)
        energy[lo : lo + 4096] = 10 * np.log10(np.einsum("ij,ij->i", part, part) / s.frame + 1e-10)
    return mels, energy


def segments(energy: np.ndarray, s: Settings) -> list[tuple[int, int]]:
    """Runs of frames above the lower threshold that touch the upper one (hysteresis): (first frame, end)."""
    if not len(energy):
        return []
    loud = energy.max()
    over = np.concatenate([[False], energy >= loud + s.off, [False]])
    edges = np.flatnonzero(over[1:] != over[:-1])
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if (energy[a:b] >= loud + s.on).any()]


def describe(media: bytes, s: Settings = Settings()) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """Tensors (n, frames, bands) of a file, the time span in seconds of each, and its segments in seconds."""
    data, rate = samples(media)
    if rate != s.rate:
        s = Settings(**{**s.__dict__, "rate": rate})
    x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    y = resample(x, s)
    mels, energy = log_mel(y - y.mean() if len(y) else y, s)
    n = -(-len(mels) // s.frames)
    tensors = np.full((n * s.frames, s.bands), np.float32(np.log(1e-6)), np.float32)
    tensors[: len(mels)] = mels
    second = lambda frame: frame * s.hop / s.target
    spans = [(second(i * s.frames), second(min((i + 1) * s.frames, len(mels)))) for i in range(n)]
    return tensors.reshape(n, s.frames, s.bands), spans, [(second(a), second(b)) for a, b in segments(energy, s)]


_SPANS = "array<struct<start:double,end:double>>"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text's UTF-8 bytes, zero bytes up to a positive multiple of 64, as a WAVE file.

    Null texts count as empty and store 64 zero bytes. Every row is kept, repeated ones too; other columns go, whatever their names.
    """

    def write(batches):
        for batch in slices(batches, "text"):
            data, offs = raw(batch.column("text"))
            whole, size = data.tobytes(), np.diff(offs)
            media = [wave(whole[a:b] + b"\0" * (max(1, -(-(b - a) // BLOCK)) * BLOCK - (b - a))) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts(docs, id_col, text_col).mapInArrow(write, "doc_id long, n_bytes long, media binary")


def features(stored: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``stored`` with what its ``media`` hold: ``payload`` (the samples read back), ``tensor_file`` (log-mel tensors of
    shape (frames, bands) as :func:`tensor_file` writes them), ``tensors`` (their flat values, read back from it),
    ``spans`` (seconds of each tensor) and ``segments`` (seconds of sound). A null file gives nulls.

    Every row is kept, repeated ones with equal values; an empty table gives an empty one; other columns stay. A column named
    as a result is an error.
    """
    refuse(stored, "payload", "tensor_file", "tensors", "spans", "segments")
    names = stored.columns
    span = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))

    def read(batches):
        for batch in slices(batches, "media"):
            payload, written, flat, sizes, spans, parts = [], [], [], [], [], []
            for media in batch.column("media").to_pylist():
                if media is None:
                    payload.append(None), written.append(None), spans.append(None), parts.append(None), sizes.append(0)
                    continue
                tensors, t, found = describe(media, settings)
                payload.append(samples(media)[0])
                written.append(tensor_file(tensors, t, settings))
                flat.append(read_tensors(written[-1])[0].reshape(-1))
                sizes.append(tensors.size)
                spans.append([{"start": a, "end": b} for a, b in t])
                parts.append([{"start": a, "end": b} for a, b in found])
            values = np.concatenate(flat) if flat else np.zeros(0, np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payload, pa.binary()), pa.array(written, pa.binary()), lists(values, np.array(sizes, np.int64), pa.float32()), pa.array(spans, span), pa.array(parts, span)], [*names, "payload", "tensor_file", "tensors", "spans", "segments"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
    return stored.mapInArrow(read, f"{fields}, payload binary, tensor_file binary, tensors array<float>, spans {_SPANS}, segments {_SPANS}")


def tensor_array(values: pa.ListArray, settings: Settings = Settings()) -> pa.ExtensionArray:
    """The ``tensors`` column of an Arrow batch as fixed-shape tensors, all rows' tensors one after another."""
    shape = (settings.frames, settings.bands)
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), shape, dim_names=("frame", "band")), pa.FixedSizeListArray.from_arrays(values.flatten(), shape[0] * shape[1]))


def tensor_file(tensors: np.ndarray, spans: list[tuple[float, float]], settings: Settings = Settings()) -> bytes:
    """An Arrow stream with a row for each tensor (n, frames, bands): ``tensor``, of the fixed-shape type, ``start`` and ``end`` (seconds)."""
    column = tensor_array(lists(tensors.reshape(-1), np.array([tensors.size]), pa.float32()), settings)
    start, end = (pa.array([span[i] for span in spans], pa.float64()) for i in (0, 1))
    batch = pa.RecordBatch.from_arrays([column, start, end], ["tensor", "start", "end"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(file: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Tensors (n, frames, bands) and spans of a file by :func:`tensor_file`."""
    batch = pa.ipc.open_stream(file).read_next_batch()
    return batch.column("tensor").to_numpy_ndarray(), list(zip(batch.column("start").to_pylist(), batch.column("end").to_pylist()))


def op9_audio_features(spark, sf_dir: str) -> DataFrame:
    out = features(store(table(spark, sf_dir, "documents")))
    size = F.length("payload")
    active = F.aggregate("segments", F.lit(0.0), lambda n, x: n + x["end"] - x["start"])
    width = Settings.bands
    low = F.transform(F.slice("tensors", 1, width), lambda x: F.format_string("%.1f", x))
    feature = F.concat_ws("|", F.size("spans"), F.size("segments"), F.format_string("%.2f", active), F.array_join(F.slice(low, 1, 8), ","))
    return out.select("doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
