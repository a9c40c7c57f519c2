"""EXIF from the bytes of an image file.

Reads the TIFF directories of a JPEG's APP1 segment, a PNG's eXIf chunk or a
TIFF file: the first directory, its Exif directory merged in, and the GPS
directory apart.  Anything that can't be read gives no tags.
"""

from __future__ import annotations

import struct

#: Names of tags by number; others keep their number.
TAGS = {
    0x000B: "ProcessingSoftware", 0x00FE: "NewSubfileType", 0x0100: "ImageWidth", 0x0101: "ImageLength", 0x0102: "BitsPerSample", 0x0103: "Compression", 0x0106: "PhotometricInterpretation",
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0115: "SamplesPerPixel", 0x011A: "XResolution", 0x011B: "YResolution", 0x011C: "PlanarConfiguration",
    0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x013E: "WhitePoint", 0x013F: "PrimaryChromaticities", 0x0211: "YCbCrCoefficients", 0x0213: "YCbCrPositioning",
    0x0214: "ReferenceBlackWhite", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8769: "ExifOffset", 0x8822: "ExposureProgram", 0x8825: "GPSInfo", 0x8827: "ISOSpeedRatings",
    0x8830: "SensitivityType", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9101: "ComponentsConfiguration", 0x9102: "CompressedBitsPerPixel", 0x9201: "ShutterSpeedValue",
    0x9202: "ApertureValue", 0x9203: "BrightnessValue", 0x9204: "ExposureBiasValue", 0x9205: "MaxApertureValue", 0x9206: "SubjectDistance", 0x9207: "MeteringMode", 0x9208: "LightSource", 0x9209: "Flash",
    0x920A: "FocalLength", 0x927C: "MakerNote", 0x9286: "UserComment", 0x9290: "SubsecTime", 0x9291: "SubsecTimeOriginal", 0x9292: "SubsecTimeDigitized", 0xA000: "FlashPixVersion", 0xA001: "ColorSpace",
    0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight", 0xA005: "ExifInteroperabilityOffset", 0xA20E: "FocalPlaneXResolution", 0xA20F: "FocalPlaneYResolution", 0xA210: "FocalPlaneResolutionUnit",
    0xA217: "SensingMethod", 0xA300: "FileSource", 0xA301: "SceneType", 0xA401: "CustomRendered", 0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA404: "DigitalZoomRatio", 0xA405: "FocalLengthIn35mmFilm",
    0xA406: "SceneCaptureType", 0xA407: "GainControl", 0xA408: "Contrast", 0xA409: "Saturation", 0xA40A: "Sharpness", 0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber", 0xA432: "LensSpecification",
    0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber",
}
GPS_TAGS = {0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 16: "GPSImgDirectionRef", 17: "GPSImgDirection", 18: "GPSMapDatum", 29: "GPSDateStamp"}
#: Sizes and codes of the value types 1 to 12.
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}


def _tiff(data: bytes) -> bytes:
    """The TIFF block of a file, or nothing."""
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + size
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = int.from_bytes(data[at : at + 4], "big")
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    elif data[:4] in (b"II*\0", b"MM\0*"):
        return data
    return b""


def _directory(t: bytes, order: str, at: int) -> dict[int, object]:
    out: dict[int, object] = {}
    (n,) = struct.unpack_from(order + "H", t, at)
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", t, at + 2 + 12 * k)
        size, code = _TYPES.get(kind, (0, ""))
        if not size:
            continue
        where = at + 10 + 12 * k
        if size * count > 4:
            (where,) = struct.unpack_from(order + "I", t, where)
        if where + size * count > len(t):
            continue
        if code == "s":
            value: object = t[where : where + count]
        else:
            values = struct.unpack_from(order + code * count, t, where)
            if len(code) == 2:
                values = tuple(a / b if b else 0.0 for a, b in zip(values[::2], values[1::2], strict=True))
            value = values[0] if len(values) == 1 else values
        out[tag] = value
    return out


def _shown(value: object) -> str:
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace").strip("\0")
    if isinstance(value, tuple):
        return ", ".join(map(_shown, value))
    return f"{value:g}" if isinstance(value, float) else str(value)


def read_exif(data: bytes | None) -> tuple[dict[str, str], dict[str, str], int]:
    """Tags by name, GPS tags by name, and the orientation (1 where there is none)."""
    try:
        t = _tiff(data or b"")
        if len(t) < 8:
            return {}, {}, 1
        order = "<" if t[:2] == b"II" else ">"
        tags = _directory(t, order, struct.unpack_from(order + "I", t, 4)[0])
        if isinstance(sub := tags.get(0x8769), int):
            tags |= _directory(t, order, sub)
        gps = _directory(t, order, at) if isinstance(at := tags.get(0x8825), int) else {}
        turn = tags.get(0x0112, 1)
        shown = {TAGS.get(k, str(k)): _shown(v) for k, v in tags.items()}
        places = {GPS_TAGS.get(k, str(k)): _shown(v) for k, v in gps.items()}
        if gps:
            shown["GPSInfo"] = "; ".join(f"{k}={v}" for k, v in places.items())
        return shown, places, turn if isinstance(turn, int) and 1 <= turn <= 8 else 1
    except (struct.error, ValueError, IndexError):
        return {}, {}, 1
