"""Daily-panel analytics on Spark: dense panels, flow features, rankings, lifecycles."""
