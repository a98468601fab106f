"""Configuration of a run: thresholds, data files and their handlers, and inference options, from XML or code."""

from __future__ import annotations

import dataclasses
import xml.etree.ElementTree as ET
from collections.abc import Callable

from netquill.operators.observations import THRESHOLDS


@dataclasses.dataclass
class DataFile:
    path: str
    data_type: str
    handler: str = "discrete"
    options: dict[str, str] = dataclasses.field(default_factory=dict)


@dataclasses.dataclass
class Config:
    thresholds: dict[str, list[float]] = dataclasses.field(default_factory=lambda: dict(THRESHOLDS))
    files: list[DataFile] = dataclasses.field(default_factory=list)
    factor_values: dict[str, list[float]] = dataclasses.field(default_factory=dict)
    properties: dict[str, str] = dataclasses.field(default_factory=dict)
    learn: bool = False
    tolerance: float = 1e-6
    rounds: int = 10_000
    gibbs_draws: int = 500


#: Handlers by name: functions of a long observation table that add its evidence columns.
HANDLERS: dict[str, Callable] = {}


def handler(name: str):
    """Register an observation handler under ``name``."""

    def put(f: Callable) -> Callable:
        HANDLERS[name] = f
        return f

    return put


def _register() -> None:
    from netquill.operators.observations import discretized, empirical, mixture, scored_mutations

    for name, f in {"discrete": discretized, "empirical": empirical, "mixture": mixture, "mutation": scored_mutations}.items():
        HANDLERS.setdefault(name, f)


def evidence(file: DataFile, obs, config: Config, **more):
    """The evidence columns that a data file's handler adds to its observations. ``more`` goes to the handler, such as the scores
    of all mutations."""
    _register()
    options = {"thresholds": config.thresholds} if file.handler in ("discrete", "mixture") else {}
    if "states" in file.options:
        options["states"] = int(file.options["states"])
    return HANDLERS[file.handler](obs, **options, **more)


def parse(text: str) -> Config:
    """A configuration from XML text. Unknown handlers raise; what isn't given keeps its default."""
    _register()
    root, c = ET.fromstring(text), Config()
    for e in root.iterfind("thresholds/threshold"):
        c.thresholds[e.get("type")] = [float(x) for x in (e.text or "").split(",")]
    for e in root.iterfind("dataFiles/dataFile"):
        name = e.get("handler", "discrete")
        if name not in HANDLERS:
            raise ValueError(f"unknown handler {name}")
        c.files.append(DataFile((e.text or "").strip(), e.get("type"), name, {k: v for k, v in e.attrib.items() if k not in ("type", "handler")}))
    for e in root.iterfind("factorValues/values"):
        c.factor_values[e.get("name")] = [float(x) for x in (e.text or "").split(",")]
    c.properties = {e.get("name"): (e.text or "").strip() for e in root.iterfind("properties/property")}
    if (e := root.find("learnParameters")) is not None:
        c.learn = (e.text or "").strip().lower() == "true"
    if (e := root.find("propagation")) is not None:
        c.tolerance, c.rounds = float(e.get("tolerance", c.tolerance)), int(e.get("rounds", c.rounds))
    if (e := root.find("gibbs")) is not None:
        c.gibbs_draws = int(e.get("draws", c.gibbs_draws))
    return c
