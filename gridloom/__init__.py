"""A PySpark analytics engine for labelled collections of gridded images and the tables that describe them."""
