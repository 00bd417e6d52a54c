"""Transfer functions as text: the fixed-layout z-file, and writers of EDI and XML.

A z-file has a header, one line per channel, and per period the transfer functions
(one line per output, real and imaginary part per input), the lower triangle of the
inverse signal power and the lower triangle of the residual covariance.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_NUMBER = re.compile(r"[+-]?\d+\.?\d*(?:[EeDd][+-]?\d+)?")


@dataclass
class Period:
    period: float
    level: int
    k_lo: int
    k_hi: int
    n: int
    fs: float
    tf: list[list[complex]]
    signal: list[list[complex]] = field(default_factory=list)
    noise: list[list[complex]] = field(default_factory=list)


@dataclass
class ZFile:
    station: str
    title: str
    periods: list[Period]
    channels: list[tuple[int, float, float, str, str]]

    @property
    def outputs(self) -> list[str]:
        return [c[4].lower() for c in self.channels[2:]]

    @property
    def inputs(self) -> list[str]:
        return [c[4].lower() for c in self.channels[:2]]


def default_orientation(station: str, n_channels: int = 5) -> list[tuple[int, float, float, str, str]]:
    """Two magnetic inputs, the vertical field if there is one, two electric channels."""
    if n_channels not in (4, 5):
        raise ValueError("a transfer function has four or five channels")
    kinds = [("Hx", 0.0), ("Hy", 90.0), ("Hz", 0.0), ("Ex", 0.0), ("Ey", 90.0)]
    kept = kinds if n_channels == 5 else [k for k in kinds if k[0] != "Hz"]
    return [(i + 1, azimuth, 0.0, station[:3], name) for i, (name, azimuth) in enumerate(kept)]


def _numbers(line: str) -> list[float]:
    return [float(x.replace("D", "E").replace("d", "e")) for x in _NUMBER.findall(line)]


def _pairs(line: str) -> list[complex]:
    v = _numbers(line)
    return [complex(a, b) for a, b in zip(v[0::2], v[1::2], strict=True)]


def parse_zfile(lines: Iterable[str]) -> ZFile:
    rows = [x.rstrip("\n") for x in lines]
    station = next((x.split(":", 1)[1].strip() for x in rows if x.lower().startswith("station")), "")
    counts = next(i for i, x in enumerate(rows) if "number of channels" in x)
    n_channels, n_periods = (int(v) for v in _numbers(rows[counts])[:2])
    channels = []
    for x in rows[counts + 2 : counts + 2 + n_channels]:
        number, azimuth, tilt, sta, name = x.split()
        channels.append((int(number), float(azimuth), float(tilt), sta, name))
    n_out, at, periods = n_channels - 2, counts + 2 + n_channels, []
    while len(periods) < n_periods:
        while not rows[at].startswith("period"):
            at += 1
        period, level, lo, hi = _numbers(rows[at].split(":", 1)[1])[:4]
        n, fs = _numbers(rows[at + 1])[:2]
        block = rows[at + 3 :]
        tf = [_pairs(x) for x in block[:n_out]]
        signal = [_pairs(x) for x in block[n_out + 1 : n_out + 3]]
        noise = [_pairs(x) for x in block[n_out + 4 : n_out + 4 + n_out]]
        periods.append(Period(period, int(level), int(lo), int(hi), int(n), fs, tf, signal, noise))
        at += 3 + n_out + 3 + 1 + n_out
    return ZFile(station, rows[2].strip() if len(rows) > 2 else "", periods, channels)


def read_zfile(spark: SparkSession, path: str) -> ZFile:
    """A z-file is a few kilobytes; Spark's reader opens it wherever it lies."""
    return parse_zfile(spark.read.text(path, wholetext=True).first()["value"].split("\n"))


def zfile_frame(spark: SparkSession, z: ZFile) -> DataFrame:
    """(level from 0, band, period, output, input, re, im, n)."""
    seen: dict[int, int] = {}
    rows = []
    for p in z.periods:
        band = seen.get(p.level, 0)
        seen[p.level] = band + 1
        rows += [(p.level - 1, band, p.period, o, i, v.real, v.imag, p.n) for o, line in zip(z.outputs, p.tf, strict=True) for i, v in zip(z.inputs, line, strict=True)]
    return spark.createDataFrame(rows, "level int, band int, period double, output string, input string, re double, im double, n long")


def _complex_line(values: Iterable[complex]) -> str:
    return "".join(f" {v.real: .4E} {v.imag: .4E}" for v in values)


def format_zfile(z: ZFile) -> str:
    out = [" **** IMPEDANCE IN MEASUREMENT COORDINATES ****", " ********** WITH FULL ERROR COVARINCE**********", f"{z.title:<80}", f"station    :{z.station:<20}"]
    out += ["coordinate  0     0.000  declination     0.00", f"number of channels {len(z.channels):3d}   number of frequencies {len(z.periods):4d}", " orientations and tilts of each channel "]
    out += [f"{n:5d} {az:8.2f} {tilt:8.2f} {sta:<3} {name:>3}" for n, az, tilt, sta, name in z.channels]
    out.append("")
    for p in z.periods:
        out += [f"period : {p.period:12.5f}    decimation level {p.level:3d}    freq. band from {p.k_lo:4d} to {p.k_hi:4d}", f"number of data point {p.n:6d} sampling freq. {p.fs:7.3f} Hz", " Transfer Functions"]
        out += [_complex_line(v) for v in p.tf] + [" Inverse Coherent Signal Power Matrix"] + [_complex_line(v) for v in p.signal] + [" Residual Covariance"] + [_complex_line(v) for v in p.noise]
    return "\n".join(out) + "\n"


def clip_periods(z: ZFile, n: int) -> ZFile:
    """Without the last ``n`` periods; the header's count follows."""
    return ZFile(z.station, z.title, z.periods[: len(z.periods) - n] if n else list(z.periods), list(z.channels))


def from_estimates(rows: list, bands: dict[tuple[int, int], dict], station: str, inputs: list[str], outputs: list[str], title: str = "Robust Single station") -> ZFile:
    """From collected estimate rows (as many as bands, outputs and inputs) to a z-file; missing covariances are zero."""
    by = {(r["level"], r["band"], r["output"], r["input"]): r for r in rows}
    keys = sorted({(r["level"], r["band"]) for r in rows}, key=lambda k: bands[k]["period"])
    periods = []
    for k in keys:
        b = bands[k]
        get = lambda o, i, k=k: by.get((*k, o, i))
        value = lambda r: complex(r["re"], r["im"]) if r is not None and r["re"] is not None else complex(0, 0)
        some = next(r for o in outputs for i in inputs if (r := get(o, i)) is not None)
        cov = [[complex(0, 0)] * 2 for _ in inputs]
        for a, x in enumerate(inputs):
            r = get(some["output"], x)
            if r is not None and "cov_ss_re" in r.asDict() and r["cov_ss_re"] is not None:
                cov[a] = [complex(u, v) for u, v in zip(r["cov_ss_re"], r["cov_ss_im"], strict=True)]
        noise = []
        for j, o in enumerate(outputs):
            r = get(o, inputs[0])
            own = r.asDict().get("cov_nn") if r is not None else None
            noise.append([complex(0, 0)] * j + [complex(own or 0.0, 0)])
        periods.append(Period(b["period"], k[0] + 1, b["k_lo"], b["k_hi"], some["n"], b["fs"], [[value(get(o, i)) for i in inputs] for o in outputs], [cov[0][:1], cov[1][:2]], noise))
    return ZFile(station, title, periods, default_orientation(station, 2 + len(outputs)))


def format_edi(z: ZFile) -> str:
    """Impedances and tippers in the sections of an EDI file."""
    freqs = [1 / p.period for p in z.periods]
    out = [">HEAD", f"  DATAID={z.station}", "  EMPTY=1.0e+32", ">=DEFINEMEAS", "  REFTYPE=CART", ">=MTSECT", f"  SECTID={z.station}", f"  NFREQ={len(freqs)}"]
    block = lambda name, v: [f">{name} //{len(v)}", "  " + " ".join(f"{x: .6E}" for x in v)]
    out += block("FREQ", freqs)
    names = {"ex": "ZX", "ey": "ZY", "hz": "T"}
    for i, o in enumerate(z.outputs):
        for j, x in enumerate("XY"):
            v = [p.tf[i][j] for p in z.periods]
            tag = f"{names[o]}{x}" if o != "hz" else f"T{x}"
            suffix = ("R", "I") if o != "hz" else ("R.EXP", "I.EXP")
            out += block(tag + suffix[0], [a.real for a in v]) + block(tag + suffix[1], [a.imag for a in v])
    return "\n".join([*out, ">END", ""])


def parse_edi(text: str) -> dict[str, list[float]]:
    """Data blocks of an EDI file by name."""
    out: dict[str, list[float]] = {}
    for part in re.split(r"^>", text, flags=re.M)[1:]:
        head, _, body = part.partition("\n")
        if "//" in head:
            out[head.split()[0]] = [float(x) for x in body.split()]
    return out


def edi_frame(spark: SparkSession, text: str) -> DataFrame:
    """(period, output, input, re, im) of an EDI file's impedances and tippers; values that stand for "empty" are NULL."""
    blocks = parse_edi(text)
    found = re.search(r"EMPTY\s*=\s*(\S+)", text, flags=re.I)
    empty = float(found.group(1)) if found else 1e32
    rows = []
    for output, real, imaginary in (("ex", "ZX{}R", "ZX{}I"), ("ey", "ZY{}R", "ZY{}I"), ("hz", "T{}R.EXP", "T{}I.EXP")):
        for letter, inp in (("X", "hx"), ("Y", "hy")):
            for f, a, b in zip(blocks.get("FREQ", []), blocks.get(real.format(letter), []), blocks.get(imaginary.format(letter), []), strict=False):
                there = a != empty and b != empty
                rows.append((1 / f, output, inp, a if there else None, b if there else None))
    return spark.createDataFrame(rows, "period double, output string, input string, re double, im double")


def read_tf(spark: SparkSession, path: str) -> DataFrame:
    """A transfer function for comparison, from a z-file or, by its ending, an EDI file."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    return edi_frame(spark, text) if path.lower().endswith(".edi") else zfile_frame(spark, parse_zfile(text.split("\n")))


def format_xml(z: ZFile) -> str:
    """Transfer functions as XML: one element per period with its estimates."""
    from xml.sax.saxutils import escape, quoteattr

    out = ['<?xml version="1.0" encoding="UTF-8"?>', "<EM_TF>", f"  <Site><Id>{escape(z.station)}</Id></Site>", f'  <Data count="{len(z.periods)}">']
    for p in z.periods:
        out.append(f'    <Period value="{p.period:.6E}" units="secs">')
        for name, which in (("Z", ("ex", "ey")), ("T", ("hz",))):
            rows = [(o, i, v) for o, line in zip(z.outputs, p.tf, strict=True) if o in which for i, v in zip(z.inputs, line, strict=True)]
            if rows:
                out.append(f'      <{name} type="complex">')
                out += [f"        <value output={quoteattr(o.capitalize())} input={quoteattr(i.capitalize())}>{v.real:.6E} {v.imag:.6E}</value>" for o, i, v in rows]
                out.append(f"      </{name}>")
        out.append("    </Period>")
    return "\n".join([*out, "  </Data>", "</EM_TF>", ""])


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text file in whatever store the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()
