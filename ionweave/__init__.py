"""ionweave: tandem mass-spectrum clustering expressed as Spark DataFrame jobs."""

from ionweave.config import ClusterConfig, PretrainConfig

__all__ = ["ClusterConfig", "PretrainConfig"]
