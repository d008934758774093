"""Route extraction from source text: one function a framework, run distributed over files."""
