"""Evidence-backed property graphs of source code and other artefacts, on Spark."""
