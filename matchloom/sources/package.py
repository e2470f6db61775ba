"""Pack the two result files, the code and a method note into one archive."""

from __future__ import annotations

import re
import zipfile
from pathlib import Path

RESULTS = ("matching_results.tsv", "candidate_pairs.tsv")


def build(team: str, out_dir: str, dest_dir: str, methodology: str, repo: str | None = None) -> tuple[Path, list[str]]:
    """(archive path, names in it); exits on a bad team name or missing results."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", team):
        raise SystemExit(f"team name {team!r} may hold letters, digits, '_', '-' and '.' only")
    results, root = Path(out_dir), Path(repo or Path(__file__).resolve().parents[2])
    if missing := [f for f in RESULTS if not (results / f).is_file()]:
        raise SystemExit(f"{missing} missing in {results}")
    inner = "code/business_entity_resolution"
    files = {f"output/{f}": results / f for f in RESULTS}
    files |= {f"{inner}/{p.relative_to(root).as_posix()}": p for p in sorted((root / "matchloom").rglob("*.py"))}
    files |= {f"{inner}/README.md": root / "README.md", "Documentation_template.md": Path(methodology)}
    archive = Path(dest_dir) / f"{team}_submission.zip"
    archive.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for name, path in files.items():
            z.write(path, name)
    return archive, list(files)
