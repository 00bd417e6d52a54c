"""Processing configuration: frozen dataclasses that go to JSON and back."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from fieldspark.operators.regression import RobustParams
from fieldspark.operators.windows import WindowScheme
from fieldspark.sources.bandfile import PACKAGED, Bands, band_table


@dataclass(frozen=True)
class LevelConfig:
    level: int
    factor: int
    length: int = 256
    overlap: int = 32
    family: str = "boxcar"
    args: tuple[float, ...] = ()
    clock_zero_type: str = "ignore"
    clock_zero: float = 0.0
    min_windows: int = 0
    prewhiten: bool = True
    recolor: bool = True
    detrend: str = "linear"
    save_coefficients: str | None = None

    def scheme(self, fs: float) -> WindowScheme:
        return WindowScheme(self.length, self.overlap, self.family, tuple(self.args), fs)


@dataclass(frozen=True)
class Processing:
    station: str
    remote: str | None = None
    fs: float = 1.0
    levels: tuple[LevelConfig, ...] = ()
    bands: tuple[tuple[int, int, int], ...] = ()
    inputs: tuple[str, ...] = ("hx", "hy")
    outputs: tuple[str, ...] = ("ex", "ey", "hz")
    reference: tuple[str, ...] = ("hx", "hy")
    engine: str = "RME_RR"
    estimate_per_channel: bool = True
    decimation: str = "iir"
    leverage: bool = True
    robust: RobustParams = field(default_factory=RobustParams)
    scale: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        if not levels_valid([(v.level, v.factor) for v in self.levels]):
            raise ValueError("levels count up by one from 0, and level 0 has factor 1")

    def rate(self, level: int) -> float:
        rate = self.fs
        for v in self.levels[: level + 1]:
            rate /= v.factor
        return rate

    def decimation_info(self) -> dict[int, int]:
        return {v.level: v.factor for v in self.levels}

    def schemes(self) -> dict[int, WindowScheme]:
        return {v.level: v.scheme(self.rate(v.level)) for v in self.levels}

    def level_rows(self) -> list[tuple]:
        at, rows = 1, []
        for v in self.levels:
            at *= v.factor
            rows.append((v.level, v.factor, self.fs / at, v.length, v.overlap, v.length - v.overlap, at, max(1, v.min_windows)))
        return rows

    def level_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.level_rows(), "level int, factor int, sample_rate double, length int, overlap int, advance int, total_factor int, min_windows int")

    def band_table(self, spark: SparkSession) -> DataFrame:
        return band_table(spark, list(self.bands), self.fs, [v.factor for v in self.levels], [v.length for v in self.levels])

    def with_engine_for(self, has_remote: bool) -> Processing:
        """Without a remote station a remote-reference engine becomes the single-station one."""
        return self if has_remote or self.engine != "RME_RR" else replace(self, engine="RME", remote=None)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @staticmethod
    def from_json(text: str) -> Processing:
        d = json.loads(text)
        d["levels"] = tuple(LevelConfig(**(v | {"args": tuple(v["args"])})) for v in d["levels"])
        d["bands"] = tuple(tuple(b) for b in d["bands"])
        d["robust"] = RobustParams(**d["robust"])
        for k in ("inputs", "outputs", "reference"):
            d[k] = tuple(d[k])
        return Processing(**d)


def levels_valid(levels: Sequence[tuple[int, int]]) -> bool:
    return not levels or (levels[0] == (0, 1) and all(b[0] == a[0] + 1 for a, b in zip(levels[:-1], levels[1:], strict=True)))


def create_config(station: str, fs: float, remote: str | None = None, band_set: str | None = None, bands: Bands | None = None, factors: Sequence[int] | None = None, lengths: Sequence[int] | None = None, length: int = 128, overlap: int = 32, family: str = "boxcar", **more) -> Processing:
    """A configuration from a named band set or a band table - not from both; by default the default set.

    Factors are 1 and then 4 unless given; every level has the same window unless ``lengths`` says otherwise.
    """
    if band_set is not None and bands is not None:
        raise ValueError("bands come from a named set or from a table, not from both")
    table = bands if bands is not None else PACKAGED[band_set or "default"]
    n = len({b[0] for b in table})
    factors = list(factors or [1, *[4] * (n - 1)])
    lengths = list(lengths or [length] * n)
    levels = tuple(LevelConfig(i, f, m, overlap, family) for i, (f, m) in enumerate(zip(factors, lengths, strict=True)))
    return Processing(station, remote, fs, levels, tuple(tuple(b) for b in table), **more)


def save_config(spark: SparkSession, config: Processing, path: str) -> None:
    from fieldspark.sources.zfile import write_text

    write_text(spark, config.to_json(), path)


def load_config(spark: SparkSession, path: str) -> Processing:
    return Processing.from_json(spark.read.text(path, wholetext=True).first()["value"])
