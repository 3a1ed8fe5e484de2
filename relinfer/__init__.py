"""Relational transformer inference and vector analytics on Spark DataFrames."""

from relinfer.config import ModelConfig, SamplingParams

__all__ = ["ModelConfig", "SamplingParams"]
