"""Metadata of JPEG and TIFF files without an image library: size, orientation and the time of exposure."""

from __future__ import annotations

import struct

# Tags.
ORIENTATION, DATE_TIME, EXIF_FOLDER, DATE_TIME_ORIGINAL, WIDTH, LENGTH = 274, 306, 34665, 36867, 256, 257
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
START_OF_FRAME = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}


def tags(data: bytes, at: int = 0) -> dict[int, object]:
    """Tags of a TIFF structure's first folder and its EXIF folder; the latter's win."""
    order = {b"II": "<", b"MM": ">"}.get(data[at : at + 2])
    if order is None or struct.unpack_from(order + "H", data, at + 2)[0] != 42:
        raise ValueError("no TIFF header")
    found: dict[int, object] = {}

    def folder(offset: int, depth: int) -> None:
        (n,) = struct.unpack_from(order + "H", data, at + offset)
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + offset + 2 + 12 * i)
            here = at + offset + 2 + 12 * i + 8
            size = SIZES.get(kind, 0) * count
            start = here if size <= 4 else at + struct.unpack_from(order + "I", data, here)[0]
            if kind == 2:
                found[tag] = data[start : start + count].split(b"\0")[0].decode("latin-1")
            elif kind in (3, 4) and count == 1:
                found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, start)[0]
            if tag == EXIF_FOLDER and depth == 0:
                folder(int(found[tag]), 1)

    folder(struct.unpack_from(order + "I", data, at + 4)[0], 0)
    return found


def metadata(data: bytes) -> dict[str, object]:
    """width, height, orientation, timestamp (text as recorded, or NULL) and error of an image file's bytes."""
    out: dict[str, object] = {"width": None, "height": None, "orientation": None, "timestamp": None, "metadata_error": None}
    try:
        found: dict[int, object] = {}
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 4 <= len(data) and data[at] == 0xFF:
                marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
                if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                    found = tags(data, at + 10)
                if marker in START_OF_FRAME:
                    out["height"], out["width"] = struct.unpack_from(">HH", data, at + 5)
                    break
                at += 2 + size
            if out["width"] is None:
                raise ValueError("no frame header")
        elif data[:8] == b"\x89PNG\r\n\x1a\n":
            out["width"], out["height"] = struct.unpack_from(">II", data, 16)
        else:
            found = tags(data)
            out["width"], out["height"] = found.get(WIDTH), found.get(LENGTH)
        out["orientation"] = found.get(ORIENTATION)
        out["timestamp"] = found.get(DATE_TIME_ORIGINAL) or found.get(DATE_TIME)
    except (ValueError, struct.error, IndexError) as e:
        out["metadata_error"], out["timestamp"] = f"{type(e).__name__}: {e}", None
    return out
