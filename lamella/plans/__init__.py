"""The level tree and everything that follows from it and a schema, without running a job."""
