"""gridloom: spatial-unit tables, graph diffusion, linear algebra and dynamics on PySpark."""
