"""kvern.sources"""
