"""All knobs of a linkage run, in one object that training and serving share."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Weights:
    """What a shared blocking key adds to a pair's score.

    The first three are constants; a rare key of document frequency f adds
    weight / (1 + sqrt(f)).
    """

    exact: float = 100.0
    core: float = 80.0
    addr: float = 60.0
    ntok: float = 15.0
    atok: float = 20.0
    ngram: float = 40.0
    agram: float = 50.0


@dataclass(frozen=True)
class ErConfig:
    token_max_df: int = 100
    gram_max_df: int = 5000
    grams_per_record: int = 1
    top_k: int = 100
    rank_by: str = "block"  # or "match": score every blocked pair first
    long_addresses: bool = False
    allow_empty_exact_name: bool = False
    threshold: float = 0.60
    linear_threshold: float = 0.80
    name_weight: float = 0.40
    address_weight: float = 0.60
    features: int = 13
    kinds: tuple[str, ...] = ("exact", "core", "addr", "ntok", "atok", "ngram", "agram")
    weights: Weights = field(default_factory=Weights)


_LINEAR = ErConfig(top_k=200, linear_threshold=0.86)
_TREES = ErConfig()
#: The stages of the method's development, as configurations.
PRESETS = {
    "v1": ErConfig(kinds=("exact", "atok"), top_k=1_000_000_000, allow_empty_exact_name=True),
    "v2": ErConfig(kinds=("exact", "ntok", "atok"), top_k=1_000_000_000, allow_empty_exact_name=True),
    "v3": ErConfig(top_k=50),
    "v4": ErConfig(top_k=50, rank_by="match"),
    "v4_safe": ErConfig(top_k=50, rank_by="match", linear_threshold=0.86),
    "v7": _LINEAR,
    "v10": _LINEAR,
    "v12": replace(_TREES, features=9, long_addresses=True),
    "v15": replace(_TREES, features=9),
    "v16": replace(_TREES, top_k=50),
    "v21": _TREES,
    "v22": replace(_TREES, grams_per_record=3),
    "v23": replace(_TREES, token_max_df=5000, grams_per_record=3, long_addresses=True),
}

#: Limits that bite on the small fixture.
FIXTURE = ErConfig(token_max_df=5, gram_max_df=50, top_k=10)


def parse(argv: list[str] | None = None) -> tuple[argparse.Namespace, ErConfig]:
    """Command line: paths, limits and every plain knob of ErConfig."""
    p = argparse.ArgumentParser(prog="kinloom", description="Link source 1 records to source 2 and 3 records.")
    p.add_argument("--source1", required=True)
    p.add_argument("--targets", required=True, nargs="+")
    p.add_argument("--truth")
    p.add_argument("--validation-ids")
    p.add_argument("--out", required=True)
    p.add_argument("--model")
    p.add_argument("--mode", choices=("train", "validate", "infer", "linear"), default="linear")
    p.add_argument("--preset", choices=PRESETS, default="v21", help="the configuration that the other options change")
    p.add_argument("--limit-s1", type=int)
    p.add_argument("--limit-target-rows", type=int)
    plain = [f for f in fields(ErConfig) if f.name not in ("weights", "kinds")]
    for f in plain:
        if isinstance(f.default, bool):
            p.add_argument("--" + f.name.replace("_", "-"), action=argparse.BooleanOptionalAction)
        else:
            p.add_argument("--" + f.name.replace("_", "-"), type=type(f.default))
    p.add_argument("--kinds", nargs="+", choices=ErConfig().kinds)
    args = p.parse_args(argv)
    given = {f.name: getattr(args, f.name) for f in plain if getattr(args, f.name) is not None}
    if args.kinds:
        given["kinds"] = tuple(args.kinds)
    return args, replace(PRESETS[args.preset], **given)
