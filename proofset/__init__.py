"""Jobs for portrait sets on Spark."""
