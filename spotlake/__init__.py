"""A Spark-native engine for images of markers, and what a training-data pipeline needs."""

from spotlake.model import Assay, from_numpy
from spotlake.pipeline import Pipeline, component, reader
from spotlake.presets import (
    beads,
    beads_pipe,
    image,
    image_pipe,
    microfluidic_chip,
    microfluidic_chip_pipe,
    mrbles,
    mrbles_pipe,
)
from spotlake.session import session
from spotlake.sources.tables import load, save

__all__ = [
    "Assay", "Pipeline", "beads", "beads_pipe", "component", "from_numpy", "image", "image_pipe", "load", "microfluidic_chip", "microfluidic_chip_pipe", "mrbles", "mrbles_pipe", "reader", "save", "session",
]
