"""strokelake: drawing-assessment analytics as Spark DataFrame jobs."""
