"""Ready pipelines for chips, coded beads, beads and plain images: their steps, and functions whose parameters are those of the steps."""

from __future__ import annotations

import inspect
from collections.abc import Callable

import spotlake.operators.filters  # noqa: F401  (registers components)
import spotlake.operators.find
import spotlake.operators.finish
import spotlake.operators.identify
import spotlake.operators.preprocess
import spotlake.operators.stitch
import spotlake.sources.reader  # noqa: F401
from spotlake.pipeline import COMPONENTS, Pipeline

#: Distances between rows and columns, in pixels, of known chips.
CHIPS = {"minichip": (375 / 1.61, 400 / 1.61), "pc": (406 / 3.22, 750 / 3.22), "ps": (375 / 3.22, 655 / 3.22)}

#: The steps of each kind of pipeline.
END = ("drop", "restore_format")
STEPS = {
    "image": ("standardize_format", "stitch", "rotate", *END),
    "chip": ("standardize_format", "identify_buttons", "stitch", "rotate", "find_buttons", *END),
    "beads": ("standardize_format", "flatfield_correct", "stitch", "find_beads", *END),
    "coded": ("standardize_format", "flatfield_correct", "stitch", "find_beads", "identify_mrbles", *END),
}


def _parameters(step: str) -> list[inspect.Parameter]:
    return list(inspect.signature(COMPONENTS[step]).parameters.values())


def ready(kind: str, doc: str, **defaults: object) -> Callable[..., Pipeline]:
    """A function that makes a pipeline of a kind. defaults: those that differ from the components' own."""
    found = {p.name: p.replace(default=defaults.get(p.name, p.default)) for step in STEPS[kind] for p in _parameters(step)}
    if "row_dist" in found:
        found["chip_type"] = inspect.Parameter("chip_type", inspect.Parameter.POSITIONAL_OR_KEYWORD, default=None)
    signature = inspect.Signature(sorted(found.values(), key=lambda p: p.default is not p.empty))

    def pipe(*args, **options) -> Pipeline:
        bound = signature.bind(*args, **options)
        bound.apply_defaults()
        values = bound.arguments
        if (chip := values.get("chip_type")) is not None:
            if chip not in CHIPS:
                raise ValueError(f"the chip type {chip!r} is not one of {', '.join(CHIPS)}")
            values["row_dist"], values["col_dist"] = CHIPS[chip]
        made = Pipeline("read")
        for step in STEPS[kind]:
            made.add_pipe(step, **{p.name: values[p.name] for p in _parameters(step)})
        return made

    pipe.__signature__, pipe.__doc__ = signature, doc
    return pipe


def applied(pipe: Callable[..., Pipeline], doc: str) -> Callable:
    """A function of data and the parameters of pipe: the assay, or a list of assays, that the pipeline makes of data."""

    def run(data, *args, **options):
        return pipe(*args, **options)(data)

    signature = inspect.signature(pipe)
    run.__signature__ = signature.replace(parameters=[inspect.Parameter("data", inspect.Parameter.POSITIONAL_OR_KEYWORD), *signature.parameters.values()])
    run.__doc__ = doc
    return run


image_pipe = ready("image", "Images stitched from tiles.")
microfluidic_chip_pipe = ready("chip", "Buttons of a chip. chip_type: a known chip, in place of row_dist and col_dist.")
beads_pipe = ready("beads", "Round beads.", min_bead_diameter=5, max_bead_diameter=25)
mrbles_pipe = ready("coded", "Round beads and the codes that their spectra tell.")

image = applied(image_pipe, "Images stitched from tiles.")
microfluidic_chip = applied(microfluidic_chip_pipe, "Buttons of a chip. chip_type: a known chip, in place of row_dist and col_dist.")
beads = applied(ready("beads", "Round beads."), "Round beads.")
mrbles = applied(mrbles_pipe, "Round beads and the codes that their spectra tell.")
