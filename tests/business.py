"""Linkage fixture without chance: firms spelled from syllables, and copies of them by a fixed table of edits.

Firm ``n`` is the same in every run. ``COPIES[n % len(COPIES)]`` says which
copies it has in the pool, each a tuple of edits; every fifth firm stands in the
pool alone. The test split has a region that training never saw.
"""

from dataclasses import dataclass, replace
from pathlib import Path

SYLLABLES = "ba co di fu ga hi jo ku la me no pu ra se ti vo wa xi yo zé".split()
#: Region: legal form and its short forms, road and its short forms, digits of a postcode.
REGIONS = {
    "North": (("Incorporated", "Inc."), ("Avenue", "Ave"), 5),
    "East": (("Private Limited", "Pvt. Ltd."), ("Road", "Rd."), 6),
    "South": (("SARL", "S.A.R.L. & Cie"), ("Boulevard", "Bd"), 5),
}


@dataclass(frozen=True)
class Firm:
    words: tuple[str, ...]
    legal: str
    house: int
    street: str
    road: str
    code: str
    region: str

    def cells(self) -> tuple[str, str, str]:
        return " ".join([*self.words, self.legal]).strip(), ", ".join(filter(None, [f"{self.house} {self.street} {self.road}", self.code])), self.region


def spelled(n: int, syllables: int) -> str:
    """A word from the digits of ``n`` in the syllables' base."""
    out = ""
    for _ in range(syllables):
        n, digit = divmod(n, len(SYLLABLES))
        out += SYLLABLES[digit]
    return out.capitalize()


def firm(n: int, region: str) -> Firm:
    (legal, _), (road, _), digits = REGIONS[region]
    seed = (n + 1) * 7919 * (len(region) + 2)
    words = (spelled(seed, 3), spelled(seed // 11, 4), spelled(n % 6, 2))
    return Firm(words, legal, 1 + seed % 790, spelled(seed // 7, 3), road, str(10 ** (digits - 1) + seed % (9 * 10 ** (digits - 1))), region)


EDITS = {
    "legal": lambda f: replace(f, legal=REGIONS[f.region][0][1]),
    "no legal": lambda f: replace(f, legal=""),
    "road": lambda f: replace(f, road=REGIONS[f.region][1][1]),
    "no code": lambda f: replace(f, code=""),
    "letter": lambda f: replace(f, words=(f.words[0][:2] + f.words[0][3:], *f.words[1:])),
    "order": lambda f: replace(f, words=f.words[1:] + f.words[:1]),
    "capitals": lambda f: replace(f, words=tuple(w.upper() for w in f.words)),
}
COPIES = [
    [("legal",)], [("road", "no code"), ("capitals",)], [], [("letter", "road")], [("order", "legal")], [("no legal", "no code"), ("letter",), ("legal", "road")], [],
]


def make_dataset(root, n=30):
    """Write both splits below ``root``; returns it."""
    root = Path(root)
    for split, regions, shift in (("train", ["North", "East"], 0), ("test", ["North", "East", "South"], 1000)):
        tables, links = {1: [], 2: [], 3: []}, []

        def add(source: int, f: Firm) -> str:
            tables[source].append((f"S{source}-{10 * len(tables[source]) + 3:06d}", *f.cells()))  # noqa: B023
            return tables[source][-1][0]

        for region in regions:
            for k in range(n * 5 // 4):
                f, alone = firm(shift + k, region), k % 5 == 4
                own = None if alone else add(1, f)
                copies = [("road",)] if alone else COPIES[k % len(COPIES)]
                found = []
                for c, edits in enumerate(copies):
                    g = f
                    for e in edits:
                        g = EDITS[e](g)
                    found.append(add(2 + (k + c) % 2, g))
                if own:
                    links.append((own, ",".join(found)))
        (root / split).mkdir(parents=True, exist_ok=True)
        for source, rows in tables.items():
            (root / split / f"{split}_source{source}.tsv").write_text("".join("\t".join(r) + "\n" for r in [("entity_id", "business_name", "business_address", "country"), *rows]), encoding="utf-8")
        if split == "train":
            (root / split / "train_ground_truth.tsv").write_text("".join(f"{a}\t{b}\n" for a, b in [("source1_entity_id", "matched_entity_ids"), *links]))
    return root
