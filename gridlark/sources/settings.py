"""Settings of a run: checks before it starts, and what becomes of it at a limit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRATEGIES = ("crash", "ignore", "disperse", "collapse")
#: Fixed names of the settings' format: values above zero, intervals counted in steps, and limits with what they allow.
POSITIVE = ("domain.radius", "domain.height", "initial.relax.cfl", "initial.relax.dampening", "initial.relax.tolerance", "evolve.cfl")
IN_STEPS = ("output.initial_relax_interval", "output.horizon_relax_interval")
ENDING = ("crash", "disperse", "collapse")
LIMITS = {
    "on_max_nodes": ENDING,
    "on_max_memory": ENDING,
    "on_max_initial_steps": ("crash", "ignore"),
    "on_max_evolve_steps": ENDING,
    "on_max_evolve_proper_time": ENDING,
    "on_max_evolve_coord_time": ENDING,
}


def setting(config: dict, name: str):
    for part in name.split("."):
        if part not in config:
            raise ValueError(f"{name} is not set")
        config = config[part]
    return config


def faults(config: dict) -> list[str]:
    """Everything that is wrong with the settings of a run, in words."""
    get = lambda name: setting(config, name)
    found = [f"{name} must be above zero" for name in POSITIVE if not get(name) > 0]
    if get("domain.cell_size") < 2 * get("domain.cell_ghost"):
        found.append("domain.cell_size must be twice domain.cell_ghost at least")
    if get("domain.global_refine") >= get("limits.max_levels"):
        found.append("domain.global_refine must be below limits.max_levels")
    found += [f"{name} must count steps" for name in IN_STEPS if set(get(name)) != {"steps"}]
    return found + [f"error_handler.{name} must be one of {', '.join(allowed)}" for name, allowed in LIMITS.items() if get(f"error_handler.{name}") not in allowed]


def validate(config: dict) -> dict:
    """The settings themselves; all their faults in one error."""
    found = faults(config)
    if found:
        raise ValueError("; ".join(found))
    return config


def outcome(reached: Column, strategy: Column) -> Column:
    """The status a run takes at a limit: null if it goes on, an error for "crash"."""
    ended = F.when(strategy == "ignore", F.lit(None).cast("string")).when(strategy == "disperse", "Disperse").when(strategy == "collapse", "Collapse")
    fail = F.when(strategy == "crash", F.raise_error(F.lit("a limit was reached")).cast("string")).otherwise(F.raise_error(F.concat(F.lit("no strategy "), strategy)).cast("string"))
    return F.when(reached, ended.otherwise(fail))
