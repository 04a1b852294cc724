"""Parameter calibration analytics as Spark DataFrame operators."""

from calib.session import get_session

__version__ = "0.1.0"
__all__ = ["get_session"]
