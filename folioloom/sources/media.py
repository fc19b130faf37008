"""Images by their headers, and the seams for formats that need a model or a library that isn't here.

``PLUGINS`` maps a format to a function from (bytes, file name) to dicts of
element columns.  Without one, the files of that format fail with a clear error
in the table of failures; nothing stands in for them silently.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

#: pdf, audio, video and ocr: registered by the user, for example audio from a speech model's (start, end, text).
PLUGINS: dict[str, Callable[[bytes, str], Iterator[dict]]] = {}


def image_size(data: bytes) -> tuple[str, int, int]:
    """(format, width, height) from an image file's header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "PNG", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "GIF", *struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        return "BMP", w, abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        if data[12:16] == b"VP8X":
            return "WEBP", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "WEBP", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        return "WEBP", *(x & 0x3FFF for x in struct.unpack("<HH", data[26:30]))
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                break
            mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "JPEG", w, h
            at += 2 + size
    if data[:4] in (b"II*\0", b"MM\0*"):
        order = "<" if data[:2] == b"II" else ">"
        (at,) = struct.unpack(order + "I", data[4:8])
        (n,) = struct.unpack(order + "H", data[at : at + 2])
        found = {}
        for k in range(n):
            tag, kind = struct.unpack(order + "HH", data[at + 2 + 12 * k : at + 6 + 12 * k])
            raw = data[at + 10 + 12 * k : at + 14 + 12 * k]
            found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), raw[: 2 if kind == 3 else 4])[0]
        return "TIFF", found[256], found[257]
    raise ValueError("not an image that is known here")


def image_mode(data: bytes) -> str:
    """How an image file keeps colours: 1, L, LA, P, RGB, RGBA, CMYK or I;16."""
    kind = image_size(data)[0]
    if kind == "PNG":
        depth, colour = data[24], data[25]
        return {0: {1: "1", 16: "I;16"}.get(depth, "L"), 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}[colour]
    if kind == "BMP":
        return {1: "1", 4: "P", 8: "P"}.get(struct.unpack("<H", data[28:30])[0], "RGB")
    if kind == "WEBP":
        alpha = data[12:16] == b"VP8X" and data[20] & 16 or data[12:16] == b"VP8L" and data[24] & 16
        return "RGBA" if alpha else "RGB"
    if kind == "JPEG":
        for mark, at, _ in _jpeg_parts(data):
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                return {1: "L", 4: "CMYK"}.get(data[at + 5], "RGB")
    if kind == "TIFF":
        tags = dict(_tiff_tags(data))
        samples, colour, depth = (tags.get(k, d) for k, d in ((277, 1), (262, 1), (258, 1)))
        depth = depth[0] if isinstance(depth, tuple) else depth
        return "P" if colour == 3 else "CMYK" if colour == 5 else {1: {1: "1", 16: "I;16"}.get(depth, "L"), 2: "LA", 4: "RGBA"}.get(samples, "RGB")
    return "P"


def _jpeg_parts(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, where its content begins, how long that is) of each segment before the picture."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        yield data[at + 1], at + 4, size - 2
        at += 2 + size


# Numbers and names of tags in pictures, as the standard has them.
TAGS = {
    256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 262: "PhotometricInterpretation", 270: "ImageDescription", 271: "Make", 272: "Model", 274: "Orientation", 277: "SamplesPerPixel",
    282: "XResolution", 283: "YResolution", 296: "ResolutionUnit", 305: "Software", 306: "DateTime", 315: "Artist", 531: "YCbCrPositioning", 33432: "Copyright", 33434: "ExposureTime", 33437: "FNumber", 34665: "ExifOffset",
    34850: "ExposureProgram", 34853: "GPSInfo", 34855: "ISOSpeedRatings", 36867: "DateTimeOriginal", 36868: "DateTimeDigitized", 37377: "ShutterSpeedValue", 37378: "ApertureValue", 37383: "MeteringMode", 37384: "LightSource",
    37385: "Flash", 37386: "FocalLength", 40961: "ColorSpace", 40962: "ExifImageWidth", 40963: "ExifImageHeight", 41986: "ExposureMode", 41987: "WhiteBalance", 41989: "FocalLengthIn35mmFilm", 41990: "SceneCaptureType", 42036: "LensModel",
}


def _tiff_tags(data: bytes, start: int | None = None) -> Iterator[tuple[int, str | int | tuple[int, ...]]]:
    """(tag, value) of a directory of tags that are text or whole numbers."""
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(order + "I", data[4:8])[0] if start is None else start
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        form = {2: "s", 3: "H", 4: "I", 8: "h", 9: "i"}.get(kind)
        if form is None or n > len(data):
            continue
        size = n * struct.calcsize(order + form)
        where = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
        raw = data[where : where + size]
        if len(raw) == size:
            found = struct.unpack(f"{order}{n}{form}", raw)
            yield tag, raw.split(b"\0")[0].decode("latin-1") if form == "s" else found[0] if n == 1 else found


def exif(data: bytes) -> dict[str, str]:
    """What a JPEG file's camera tags say in text or whole numbers, by name, or by number where there is none."""
    if data[:2] != b"\xff\xd8":
        return {}
    for mark, at, size in _jpeg_parts(data):
        if mark == 0xE1 and data[at : at + 6] == b"Exif\0\0":
            held = data[at + 6 : at + size]
            try:
                tags = dict(_tiff_tags(held))
                if isinstance(tags.get(34665), int):
                    tags |= dict(_tiff_tags(held, tags[34665]))
            except struct.error:  # damaged tags are no reason to leave the picture out
                return {}
            return {TAGS.get(t, str(t)): str(v) for t, v in sorted(tags.items())}
    return {}


def parse_image(data: bytes, name: str) -> Iterator[dict]:
    """One element for the whole picture, which says what it is."""
    kind, width, height = image_size(data)
    mode, tags = image_mode(data), exif(data)
    about = {"format": kind, "width": width, "height": height, "color_mode": mode, "file_size_bytes": len(data)} | ({"exif": tags} if tags else {})
    yield {"type": "image", "content": f"Image: {name} ({width}x{height}, {kind}, {mode})", "raw_content": None, "bbox": [0.0, 0.0, 1.0, 1.0], "metadata": about}


def segments(found: list[tuple[float, float, str]]) -> Iterator[dict]:
    """Paragraphs from what a speech model hears: (start, end, text) in seconds."""
    for start, end, text in found:
        if words := text.strip():
            times = {"start_time": round(start, 2), "end_time": round(end, 2)}
            yield {"type": "paragraph", "content": words, "raw_content": text, "metadata": times, **times}
