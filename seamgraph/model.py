"""Contracts: typed references, bounds, failures, canonical JSON."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from enum import StrEnum

VERSION = "1.0.0"
FORMAT = "seamgraph/evidence/1"
_TIGHT = (",", ":")


def _names(kind: str, words: str) -> type[StrEnum]:
    return StrEnum(kind, {w: w for w in words.split()})


Code = _names(
    "Code",
    "AnalyzerUnavailable CorruptIndex InternalFailure InvalidEvidence MissingIndex ParseFailure PublicationConflict "
    "ResolutionFailure ResourceLimitExceeded SourceChangedDuringAnalysis StaleIndex UnsafePath UnsupportedDynamicResolution UnsupportedLanguage",
)
Relation = _names(
    "Relation",
    "Call Callback Component Declaration ExternalEffect Import Include Macro Module ProjectionDependency Property Read "
    "ReceiptConsume RecoveryDependency ReverseCall TraitDispatch TypeReference Write",
)
Effect = _names(
    "Effect",
    "DERIVED_PROJECTION EXTERNAL_EFFECT PURE READ RECEIPT_READ RECEIPT_WRITE SECURITY_CONSUME UNKNOWN WRITE_BACKEND "
    "WRITE_CANONICAL WRITE_RECOVERY",
)


class EvidenceError(Exception):
    """A failure with one of the codes."""

    def __init__(self, code, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else str(code))
        self.code = Code(code)
        self.detail = detail

    def wire(self) -> dict:
        return dict(error=str(self.code), detail=self.detail)


def fail(code: str, detail: str = "") -> None:
    raise EvidenceError(Code[code], detail)


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, allow_nan=False, separators=_TIGHT)


def digest(value) -> str:
    raw = canonical(value).encode() if type(value) is not bytes else value
    return hashlib.sha256(raw).hexdigest()


@dataclasses.dataclass(frozen=True)
class Ref:
    """An opaque identity: the hash of its kind and what identifies it."""

    value: str

    @classmethod
    def of(cls, *identity):
        return cls(digest([cls.__name__, *identity]))


RepositoryRef = type("RepositoryRef", (Ref,), {"__doc__": "A repository boundary."})
PackageRef = type("PackageRef", (Ref,), {"__doc__": "A package: its manifest in a repository."})
SourceFileRef = type("SourceFileRef", (Ref,), {"__doc__": "A file by its path in the root repository."})
SymbolRef = type("SymbolRef", (Ref,), {"__doc__": "A declaration in a file."})
TypeRef = type("TypeRef", (Ref,), {"__doc__": "A type label in a file."})
StoreRef = type("StoreRef", (Ref,), {"__doc__": "A store; no analysis produces one."})
ExternalEffectRef = type("ExternalEffectRef", (Ref,), {"__doc__": "The effect outside that a symbol declares."})


class _Bounds:
    least = 1

    def check(self) -> None:
        if any(type(v) is not int or v < self.least for v in dataclasses.asdict(self).values()):
            fail("InvalidEvidence", f"bounds must be whole numbers of {self.least} or more")


@dataclasses.dataclass(frozen=True)
class Limits(_Bounds):
    """What an index may take in and give out."""

    traversal_depth: int = 16
    result_size: int = 1 << 12
    parser_seconds: int = 60
    parallel_parsers: int = 1
    queue_depth: int = 1
    memory_bytes: int = 1 << 30
    ast_nodes: int = 500_000
    edges: int = 1_000_000
    symbols: int = 500_000
    files: int = 30_000
    repository_bytes: int = 1 << 28
    file_bytes: int = 1 << 21


@dataclasses.dataclass(frozen=True)
class PacketLimits(_Bounds):
    """Sizes of one page of a packet."""

    least = 0
    max_depth: int = 1
    max_revision_inputs: int = 64
    max_effects: int = 32
    max_types: int = 32
    max_reverse_dependencies: int = 64
    max_dependencies: int = 64
    max_source_bytes: int = 1 << 13
    max_bytes: int = 1 << 16

    def check(self) -> None:
        super().check()
        if self.max_bytes < 256:
            fail("InvalidEvidence", "a packet takes 256 bytes at least")


@dataclasses.dataclass(frozen=True)
class EvidenceRequest:
    """A packet of chosen relations and effects; none chosen means all."""

    subject: Ref
    relations: tuple = ()
    effects: tuple = ()
    limits: PacketLimits = PacketLimits()
