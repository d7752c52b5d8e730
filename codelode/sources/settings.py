"""Settings of a project: TOML and properties files, with defaults. Small, and read on the driver."""

from __future__ import annotations

import tomllib
from copy import deepcopy

DEFAULTS = {
    "scan": {"max_file_size_bytes": 1 << 20, "include": [], "exclude": [], "exclude_tests": False},
    "duplication": {"mode": "sonar", "min_tokens": 100, "min_lines": 10, "normalize_identifiers": False, "fail_above_percent": 3.0},
    "coverage": {"reports": [], "exclude": [], "fail_below_percent": 80.0},
    "rules": {"max_function_lines": 50, "max_function_complexity": 15, "max_params": 5, "magic_number_min": 3, "disabled": [], "custom": []},
}


def load(toml: str = "", properties: str = "") -> dict:
    """The settings of a TOML text over the defaults, with lists of a properties text added."""
    out = deepcopy(DEFAULTS)
    for section, values in tomllib.loads(toml).items():
        if isinstance(values, dict):
            out.setdefault(section, {}).update(values)
        else:
            out[section] = values
    for key, where in (("sonar.exclusions", ("scan", "exclude")), ("sonar.inclusions", ("scan", "include")), ("sonar.coverage.exclusions", ("coverage", "exclude")),
                       ("sonar.javascript.lcov.reportPaths", ("coverage", "reports"))):
        for line in properties.splitlines():
            name, _, value = line.partition("=")
            if name.strip() == key and not line.lstrip().startswith("#"):
                out[where[0]][where[1]] = [*out[where[0]][where[1]], *(x.strip() for x in value.split(",") if x.strip())]
    return out


def ignore_patterns(text: str) -> list[str]:
    """One pattern a line, without comments and blanks."""
    return [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]
