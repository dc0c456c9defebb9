"""The logistic model of the library, under the name the tests use."""

from tallyguard.operators.onnx_logistic import logistic

__all__ = ["logistic"]
