"""What language a file claims to be."""

from __future__ import annotations

#: Extension -> language, case-sensitive.
EXTENSIONS = {
    ".C": "cpp", ".cc": "cpp", ".cxx": "cpp", ".cpp": "cpp", ".c++": "cpp", ".H": "cpp", ".h": "cpp", ".hh": "cpp", ".hxx": "cpp", ".hpp": "cpp", ".tcc": "cpp",
    ".py": "python", ".jsonnet": "jsonnet", ".fcl": "fcl",
}
LANGUAGES = ("cpp", "fcl", "python", "jsonnet")
#: The symbol of a row that holds a complete file.
WHOLE_FILE = "__WHOLE_FILE__"


def claimed(file: str | None) -> str:
    """By extension: .py, .fcl, .jsonnet, all others C++."""
    name = (file or "").rpartition("/")[2]
    ext = name[name.rfind(".") :] if "." in name else ""
    return {".py": "python", ".fcl": "fcl", ".jsonnet": "jsonnet"}.get(ext, "cpp")
