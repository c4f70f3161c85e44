"""agentguard: security analytics over tables and streams of AI-agent traffic, on PySpark."""

__version__ = "0.1.0"
