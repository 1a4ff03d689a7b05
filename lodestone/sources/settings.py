"""Settings in TOML, written with defaults where the file is missing."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    model: str = "hashed-trigrams"
    dimensions: int = 256
    editor: str = "vi"

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        p = Path(path)
        if not p.exists():
            cls().save(p)
        data = tomllib.loads(p.read_text(encoding="utf-8"))
        return cls(**{k: v for k, v in data.items() if k in cls.__dataclass_fields__})

    def save(self, path: str | Path) -> None:
        p = Path(path)
        p.parent.mkdir(parents=True, exist_ok=True)
        # a JSON string is a TOML basic string, but for DEL
        quoted = lambda v: json.dumps(v, ensure_ascii=False).replace("\x7f", "\\u007f")
        p.write_text("".join(f"{k} = {v if isinstance(v, int) else quoted(v)}\n" for k, v in asdict(self).items()), encoding="utf-8")
