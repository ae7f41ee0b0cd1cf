"""The protocol-buffer wire format, as far as the record sources need it."""

from __future__ import annotations

import struct
from collections.abc import Iterator


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of each field."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield number, kind, value


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def ints(kind: int, value) -> list[int]:
    """A repeated integer field, packed or not."""
    if kind == 0:
        return [signed(value)]
    out, at = [], 0
    while at < len(value):
        v, at = varint(value, at)
        out.append(signed(v))
    return out


def floats(value: bytes) -> list[float]:
    return list(struct.unpack(f"<{len(value) // 4}f", value))


def example(data: bytes) -> dict[str, list]:
    """The features of a tf.Example: name to a list of bytes, floats or integers."""
    out: dict[str, list] = {}
    for number, _, features in fields(data):
        if number != 1:
            continue
        for n, _, entry in fields(features):
            if n != 1:
                continue
            name, values = "", []
            for k, _, v in fields(entry):
                if k == 1:
                    name = v.decode()
                    continue
                for which, _, items in fields(v):
                    for _, kind, item in fields(items):
                        values += [item] if which == 1 else floats(item) if which == 2 else ints(kind, item)
            out[name] = values
    return out


def datum(data: bytes) -> dict:
    """A Caffe Datum, or an AnnotatedDatum around one with its boxes.

    The two can't be told apart by a mark; an AnnotatedDatum's first field is a
    message, a Datum's a number.
    """
    top = list(fields(data))
    out: dict = {"label": 0, "data": b"", "channels": 0, "height": 0, "width": 0, "boxes": [], "labels": []}
    inner = top
    if any(n == 1 and kind == 2 for n, kind, _ in top):
        inner = [f for n, _, v in top if n == 1 for f in fields(v)]
        for group in (v for n, _, v in top if n == 3):
            label = next((v for n, _, v in fields(group) if n == 1), 0)
            for annotation in (v for n, _, v in fields(group) if n == 2):
                for bbox in (v for n, _, v in fields(annotation) if n == 2):
                    f = {n: v for n, _, v in fields(bbox)}
                    edge = lambda k, f=f: struct.unpack("<f", f[k])[0] if k in f else 0.0
                    out["boxes"].append(tuple(edge(k) for k in (1, 2, 3, 4)))
                    out["labels"].append(f.get(5, label))
    names = {1: "channels", 2: "height", 3: "width", 4: "data", 5: "label"}
    for n, _, v in inner:
        if n in names:
            out[names[n]] = signed(v) if isinstance(v, int) else v
    return out


def tensors(data: bytes) -> list[dict]:
    """The tensors of a Caffe2 TensorProtos."""
    out = []
    for n, _, proto in fields(data):
        if n != 1:
            continue
        t: dict = {"dims": [], "floats": [], "ints": [], "bytes": b"", "strings": []}
        for k, kind, v in fields(proto):
            if k == 1:
                t["dims"] += ints(kind, v)
            elif k == 3:
                t["floats"] += floats(v)
            elif k in (4, 10):
                t["ints"] += ints(kind, v)
            elif k == 5:
                t["bytes"] = v
            elif k == 6:
                t["strings"].append(v)
        out.append(t)
    return out


# --- writing ---


def varint_bytes(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def message(*parts: tuple[int, object]) -> bytes:
    """Fields in order: bytes are length-delimited, floats take four bytes, integers are varints."""
    out = bytearray()
    for number, value in parts:
        if isinstance(value, bytes):
            out += varint_bytes(number << 3 | 2) + varint_bytes(len(value)) + value
        elif isinstance(value, float):
            out += varint_bytes(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint_bytes(number << 3) + varint_bytes(int(value))
    return bytes(out)


def example_bytes(binary: dict, decimals: dict, whole: dict) -> bytes:
    """A tf.Example of byte, float and integer features."""
    features = []
    for name, values in sorted((binary or {}).items()):
        features.append((name, message((1, message(*((1, bytes(v)) for v in values))))))
    for name, values in sorted((decimals or {}).items()):
        features.append((name, message((2, message((1, struct.pack(f"<{len(values)}f", *values)))))))
    for name, values in sorted((whole or {}).items()):
        features.append((name, message((3, message((1, b"".join(map(varint_bytes, values))))))))
    return message((1, message(*((1, message((1, name.encode()), (2, f))) for name, f in features))))


def datum_bytes(label: int, content: bytes, boxes: list | None = None, labels: list | None = None) -> bytes:
    """A Caffe Datum, or an AnnotatedDatum around one if ``boxes`` (x, y, width, height) are given."""
    datum = message((4, content), (5, label))
    if boxes is None:
        return datum
    groups = [(3, message((1, own), (2, message((1, 0), (2, message(*enumerate(map(float, box), 1), (5, own))))))) for box, own in zip(boxes, labels)]
    return message((1, datum), (2, 0), *groups)


def tensors_bytes(labels: list[int], content: bytes, boxes: list | None = None) -> bytes:
    """Caffe2 tensors of an image, its labels and, in the dimensions of a third, its boxes (x, y, width, height)."""
    dims = lambda values: tuple((1, int(v)) for v in values)
    third = [(1, message(*dims(v for box in boxes for v in box)))] if boxes is not None else []
    return message((1, message((1, 1), (2, 4), (6, content))), (1, message((1, len(labels)), (2, 2), *((4, n) for n in labels))), *third)
