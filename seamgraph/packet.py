"""Packets: bounded, resumable extracts of the evidence about one subject.

A page takes six categories in order, each from where the last page stopped, as far as its count, the
source budget and the page's bytes allow. A continuation names the subject, the evidence digest and the
selection that it belongs to; it grants nothing.
"""

from __future__ import annotations

from .model import Relation, SourceFileRef, SymbolRef, TypeRef, canonical, digest, fail

#: Bytes kept free for what is added after the items.
RESERVE, SOURCE_RESERVE = 768, 1024
#: A byte of text takes six in canonical JSON at most.
WORST = 6


def _resumed(continuation: dict | None, subject: str, fingerprint: str, selection: str) -> tuple[dict, int]:
    if not continuation:
        return {}, 0
    if [continuation.get(k) for k in ("subject", "digest", "selection")] != [subject, fingerprint, selection]:
        fail("StaleIndex", "the continuation is of another packet")
    positions, offset = dict(continuation.get("positions", {})), continuation.get("source_offset", 0)
    if not all(type(n) is int and n >= 0 for n in (offset, *positions.values())):
        fail("InvalidEvidence", "continuation places")
    return positions, offset


def _size(packet: dict) -> int:
    return len(canonical(packet))


class _Page:
    def __init__(self, packet: dict, limits, offset: int):
        self.packet, self.limits, self.offset, self.spent = packet, limits, offset, 0

    def _add(self, name: str, item: dict) -> bool:
        self.packet[name].append(item)
        if _size(self.packet) + RESERVE <= self.limits.max_bytes:
            return True
        self.packet[name].pop()
        return False

    def plain(self, name: str, items: list[dict]) -> int:
        """How many of the items fit."""
        for taken, item in enumerate(items):
            if not self._add(name, item):
                return taken
        return len(items)

    def sources(self, items: list[dict]) -> int:
        """How many texts are through to their end; a text may take several pages."""
        for taken, item in enumerate(items):
            raw = item["text"].encode()
            if self.offset > len(raw):
                fail("InvalidEvidence", "source place")
            room = min(self.limits.max_source_bytes - self.spent, max(0, (self.limits.max_bytes - _size(self.packet) - SOURCE_RESERVE) // WORST))
            text = raw[self.offset : self.offset + room].decode(errors="ignore")  # a cut character waits for the next page
            used = len(text.encode())
            whole = self.offset + used >= len(raw)
            if not whole and not used:
                return taken
            piece = item | {"text": text, "offset_bytes": self.offset, "source_bytes": len(raw), "slice_complete": whole}
            if not self._add("sources", piece):
                return taken
            self.spent += used
            if not whole:
                self.offset += used
                return taken
            self.offset = 0
        return len(items)


def build(index, subject, limits, continuation, relations, effects) -> dict:
    limits.check()
    own, revision = index.source_evidence(subject), index.evidence_revision(subject)
    asked = [list(map(str, relations)), list(map(str, effects)), limits.max_depth]
    fingerprint, selection = digest(revision), digest(asked)
    start, offset = _resumed(continuation, subject.value, fingerprint, selection)

    graph = index.transitive_dependencies(subject, max_depth=limits.max_depth)
    wanted = set(map(str, relations))
    chosen = [e for e in graph["edges"] if not wanted or e["kind"] in wanted]
    back = set(wanted) | ({"Call"} if "ReverseCall" in wanted else set())
    reverse = [e for e in index.dependents_of(subject) if not wanted or e["kind"] in back]
    labels = {e["target"] for e in chosen if e["target"] and e["kind"] == Relation.TypeReference}
    types = [index.type(TypeRef(t)) for t in sorted(labels)]
    is_file = isinstance(subject, SourceFileRef)
    texts = [dict(symbol=None, file=subject.value, line=1, source_digest=own["body_digest"], text=own["source"])] if is_file else []
    for s in index._among("symbols", "id", graph["subjects"]):
        texts.append(dict(symbol=s["id"], file=s["file"], line=s["line"], source_digest=s["body_digest"], text=s["source"]))
    known = index.effects_of(subject) if isinstance(subject, SymbolRef) else []
    inputs = [dict(ref=k, digest=revision["inputs"][k]) for k in sorted(revision["inputs"])]
    described = revision | dict(input_count=len(inputs), inputs_digest=digest(revision["inputs"]), representation="PagedInputSet")
    del described["inputs"]
    header = {k: v for k, v in own.items() if k != "source"}

    packet = dict(
        subject=subject.value, subject_kind="SourceFile" if is_file else "Symbol", evidence_digest=fingerprint, evidence_revision_set=described,
        owner=index.owners_of(subject), symbol=None if is_file else header, source_unit=header if is_file else None, status="Complete",
        resolution=own["resolution"], missing=own["missing"], page_start=start, omitted=[], continuation=None,
    )
    packet |= {f"requested_{k}": v for k, v in zip(("relations", "effects"), asked) if v}
    content = {
        "dependencies": (chosen, limits.max_dependencies), "reverse_dependencies": (reverse, limits.max_reverse_dependencies),
        "types": (types, limits.max_types), "effects": ([e for e in known if not effects or e["kind"] in effects], limits.max_effects),
        "sources": (texts, len(texts)), "revision_inputs": (inputs, limits.max_revision_inputs),
    }
    packet |= {name: [] for name in content}
    page, after = _Page(packet, limits, offset), {}
    for name, (items, cap) in content.items():
        at = start.get(name, 0)
        if at > len(items):
            fail("InvalidEvidence", "a place beyond its category")
        part = items[at : at + cap]
        after[name] = at + (page.sources(part) if name == "sources" else page.plain(name, part))
        if after[name] < len(items):
            packet["omitted"].append(dict(remaining=len(items) - after[name], category=name))
    more = bool(packet["omitted"])
    if graph["status"] == "Partial":
        packet["omitted"].append(dict(reason="wider bounds reach more", category="traversal"))
    packet["status"] = "Partial" if packet["omitted"] else "Complete"
    if more:
        packet["continuation"] = dict(subject=subject.value, digest=fingerprint, selection=selection, positions=after, source_offset=page.offset)
        if after == start and page.offset == offset:
            fail("ResourceLimitExceeded", "no item fits a page of these bounds")
    if _size(packet) > limits.max_bytes:
        fail("ResourceLimitExceeded", "the packet's identity alone exceeds its bytes")
    return packet
